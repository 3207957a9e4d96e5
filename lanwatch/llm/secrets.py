"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Every version of every text is addressed by its content. The ledger says which (blob, rule version) pairs have
been scanned; only the others are, one text per blob. Findings are stored per blob and joined back to all rows
that hold it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.lineage import work_folder
from .common import exists, fresh, read


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern`; those whose `group` is shorter than `least` are dropped.

    A text without `hint` (checked where given) cannot match. Raise `version` whenever anything changes.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hint: str | None = None
    version: int = 1


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    # the whole key: to its END line, or else headers and the block of base64 (also escaped or quoted) after the BEGIN line
    Rule("pem", r"""-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----|"""
                r"""(?:[ \t\r\n]+[A-Z][A-Za-z-]+: [^\r\n]*){0,8}[ \t\r\n\\"'>]*[A-Za-z0-9+/=]{16,}[A-Za-z0-9+/= \t\r\n\\"'>]*)?""",
         hint="PRIVATE KEY-----", version=2),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}", hint="eyJ"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
)
RULES = BASE + MORE

LEDGER = "blob binary, rule string, version int"
FINDINGS = "blob binary, rule string, version int, start long, `end` long"


def blob_of(text: Column) -> Column:
    """Content address of a text; a null text is the empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _raw(text: Column, pending: Column, rule: Rule) -> Column:
    """Array of (rule, version, i, gap, hit): the matches of one rule and the code points between them."""
    kind = "struct<rule:string,version:int,i:int,gap:int,hit:string>"
    pattern = F.lit(rule.pattern)
    hits, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    found = F.transform(hits, lambda hit, i: F.struct(
        F.lit(rule.kind).alias("rule"), F.lit(rule.version).alias("version"), i.alias("i"),
        F.length(F.get(gaps, i)).alias("gap"), hit.alias("hit")))
    wanted = F.array_contains(pending, rule.kind)
    if rule.hint:
        wanted = wanted & F.contains(text, F.lit(rule.hint))
    return F.when(wanted & text.rlike(rule.pattern), found.cast(f"array<{kind}>")).otherwise(F.array().cast(f"array<{kind}>"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger rows) of the pairs of blob and rule version that `ledger` does not hold.

    Only `text` is read, whole. Null and empty texts are one blob without findings. Repeated texts are scanned
    once. Spans are in code points, the end exclusive. An empty table gives empty results.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    blobs = docs.select(blob_of(F.col("text")).alias("blob"), text.alias("text"))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        work = blobs.dropDuplicates(["blob"]).withColumn("pending", F.lit([r.kind for r in rules]))
        new = docs.select(blob_of(F.col("text")).alias("blob")).distinct().select("blob", F.inline(wanted))
    else:
        new = docs.select(blob_of(F.col("text")).alias("blob")).distinct().select("blob", F.inline(wanted)) \
            .join(ledger, ["blob", "rule", "version"], "left_anti")
        pending = new.groupBy("blob").agg(F.collect_set("rule").alias("pending"))
        work = blobs.dropDuplicates(["blob"]).join(pending, "blob")
    parts = [_raw(F.col("text"), F.col("pending"), r) for r in rules]
    rows = work.select("blob", F.inline(F.concat(*parts)))
    # Offsets are running sums; the rows of one text and rule are as many as its matches.
    size = F.length("hit")
    until = F.sum(F.col("gap") + size).over(
        Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    keep = F.lit(False)
    for r in rules:
        part = F.regexp_extract("hit", r.pattern, r.group) if r.group else F.col("hit")
        keep = keep | ((F.col("rule") == r.kind) & (F.length(part) >= r.least))
    spans = rows.select("blob", "rule", "version", (until - size).alias("start"), until.alias("end"), keep.alias("keep"))
    return spans.where("keep").drop("keep"), new


def update(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan `docs` against the ledger stored below `path`, append to it, and return the stored findings.

    Findings are written before the ledger: a run that dies between the two scans its blobs again, and doubled
    findings are dropped here.
    """
    spark = docs.sparkSession
    stored = exists(spark, f"{path}/ledger/_SUCCESS")
    findings, new = scan(docs, spark.read.schema(LEDGER).parquet(f"{path}/ledger") if stored else None, rules)
    findings.write.mode("append").parquet(f"{path}/findings")
    new.write.mode("append").parquet(f"{path}/ledger")
    return spark.read.schema(FINDINGS).parquet(f"{path}/findings").distinct()


def by_path(docs: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) of every row of `docs`; spans: array of (start, order, kind, end), sorted. None: empty.

    Findings of older rule versions are left out. Spans of one blob are gathered; their number is bounded by
    the length of one text.
    """
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("rule") == r.kind) & (F.col("version") == r.version))
    kind = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
    span = F.struct("start", F.try_element_at(order, F.col("rule")).alias("rank"), F.col("rule").alias("kind"), "end")
    spans = findings.where(current).groupBy("blob").agg(F.array_sort(F.collect_list(span)).cast(kind).alias("spans"))
    return docs.select("doc_id", blob_of(F.col("text")).alias("blob")).join(spans, "blob", "left") \
        .select("doc_id", F.coalesce("spans", F.array().cast(kind)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def _is(kind: str):
    return lambda span: span.kind == kind


def redact(docs: DataFrame, findings: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every found span of `text` replaced by `mark`; overlapping spans become one.

    All columns and rows are kept; texts without findings, null ones too, are as they were.
    """
    before = F.max("end").over(Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum("new").over(Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    merged = findings.select("blob", "start", "end").distinct() \
        .withColumn("new", F.when(before > F.col("start"), 0).otherwise(1)).withColumn("part", group) \
        .groupBy("blob", "part").agg(F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end"))
    key, cuts, whole = fresh(docs, "blob"), fresh(docs, "cuts"), F.col("text")
    per_blob = merged.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cuts)).withColumnRenamed("blob", key)
    at = F.col(cuts)

    def end_before(i):
        return F.when(i == 0, F.lit(0)).otherwise(F.get(at, i - 1)["end"])

    pieces = F.transform(at, lambda c, i: F.substring(whole, end_before(i) + 1, c["start"] - end_before(i)))
    tail = F.substring(whole, F.get(at, F.size(at) - 1)["end"] + 1, F.length(whole))
    clean = F.when(at.isNull(), whole).otherwise(F.array_join(F.concat(pieces, F.array(tail)), mark))
    return docs.withColumn(key, blob_of(whole)).join(per_blob, key, "left").withColumn("text", clean).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = by_path(docs, update(docs, work_folder(spark)))
    base = F.filter("spans", lambda s: s.kind.isin([r.kind for r in BASE]))
    counts = [F.size(F.filter("spans", _is(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    """DuckDB SQL of the query: matches and the texts between them, then running sums."""
    parts = []
    for rank, r in enumerate(RULES):
        p = "'" + r.pattern.replace("'", "''") + "'"
        group = f"regexp_extract(hit, {p}, {r.group})"
        parts.append(f"""select doc_id, {rank} rnk, '{r.kind}' kind, s, e from (
 select doc_id, hit, sum(gap + length(hit)) over w - length(hit) s, sum(gap + length(hit)) over w e from (
  select doc_id, unnest(range(1, len(m) + 1)) i, unnest(m) hit, unnest(list_transform(g[1:len(m)], lambda x: length(x))) gap from (
   select doc_id, regexp_extract_all(text, {p}) m, string_split_regex(text, {p}) g from d))
  window w as (partition by doc_id order by i rows unbounded preceding)) where length({group}) >= {r.least}""")
    return ("with d as (select doc_id, coalesce(text, '') as text from documents), f as (" + " union all ".join(parts) + """),
g as (select doc_id, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access,
 count(*) filter (kind = 'hex') n_hex,
 string_agg(case when rnk < 3 then concat(kind, ':', cast(s as bigint), ':', cast(e as bigint)) end, ',' order by s, rnk) b,
 string_agg(concat(kind, ':', cast(s as bigint), ':', cast(e as bigint)), ',' order by s, rnk) spans from f group by doc_id)
select d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
 sha256(coalesce(b, '')) base_sha256, coalesce(spans, '') spans from d left join g on d.doc_id = g.doc_id""")


SQL = _sql()
