"""Alert-stream plans, incident correlation, responses and reports built from the operators."""
