"""Fixed values. Detection results depend on these exact entries."""

# Alert severities, lowest first.
SEVERITIES = ["info", "low", "medium", "high", "critical"]

# Alert categories.
CATEGORIES = [
    "arp_anomaly", "new_device", "port_scan", "beacon", "connection_anomaly",
    "dns_anomaly", "lateral_movement", "auth_anomaly", "traffic_spike",
    "process_anomaly", "threat_intel", "honeypot", "incident", "system",
]

# Seconds a dedup key stays quiet, per alert category.
CATEGORY_COOLDOWN_SECONDS = {
    "arp_anomaly": 300, "new_device": 3600, "port_scan": 300, "beacon": 1800,
    "connection_anomaly": 600, "dns_anomaly": 600, "lateral_movement": 300,
    "auth_anomaly": 300, "traffic_spike": 600, "process_anomaly": 1800,
    "threat_intel": 3600, "honeypot": 300, "incident": 600, "system": 300,
}
DEFAULT_COOLDOWN_SECONDS = 300
CRITICAL_COOLDOWN_SECONDS = 120

# Score added to a device per alert of each severity.
SUSPICION_DELTA = {"info": 0.05, "low": 0.1, "medium": 0.2, "high": 0.4, "critical": 0.8}

# MAC prefix (first three bytes) to vendor.
OUI_VENDOR = {
    "00:50:56": "VMware", "08:00:27": "VirtualBox", "52:54:00": "QEMU/KVM",
    "b8:27:eb": "Raspberry Pi Foundation", "dc:a6:32": "Raspberry Pi Foundation",
    "e4:5f:01": "Raspberry Pi Foundation", "d8:3a:dd": "Raspberry Pi Foundation",
    "28:cd:c1": "Apple", "a4:c3:f0": "Apple", "3c:22:fb": "Apple", "f0:18:98": "Apple",
    "70:56:81": "Apple", "60:f8:1d": "Google", "f4:f5:d8": "Google", "54:60:09": "Google",
    "00:1a:11": "Google", "30:fd:38": "Amazon", "f0:81:73": "Amazon", "74:c2:46": "Amazon",
    "18:74:2e": "Amazon", "cc:f9:54": "Amazon", "00:17:f2": "Apple Airport",
    "bc:30:d9": "Netgear", "a0:04:60": "Netgear", "c0:ff:d4": "TP-Link",
    "50:c7:bf": "TP-Link", "b0:be:76": "TP-Link", "14:cc:20": "TP-Link",
    "10:fe:ed": "TP-Link", "00:0d:0f": "Cisco Linksys", "00:25:9c": "Cisco",
    "00:1e:13": "Dell", "f8:db:88": "Dell", "14:18:77": "Dell",
}

# Top-level domains that count as suspicious.
SUSPICIOUS_TLDS = ["tk", "ml", "ga", "cf", "gq", "xyz", "top", "click",
                   "online", "site", "info", "biz", "pw", "cc", "ws"]

# CDN domains whose random-looking names are normal.
HIGH_ENTROPY_CDNS = ["cloudfront.net", "fastly.net", "akamaiedge.net", "edgekey.net",
                     "cloudflare.com", "akamaitechnologies.com", "amazonaws.com",
                     "googlevideo.com", "ytimg.com", "gstatic.com"]

# Destination ports that legitimately see periodic traffic.
PERIODIC_PORTS = [53, 123, 443, 80, 5353]

# Destination ports that raise the severity of a new destination.
SUSPICIOUS_PORTS = [22, 23, 135, 137, 138, 139, 445, 1433, 1521, 3306, 3389, 4444, 4445,
                    5900, 6666, 6667, 6668, 6669, 8080, 8443, 9001, 9030, 31337]

# Ordinary outbound ports, tested before the suspicious ones.
COMMON_OUTBOUND_PORTS = [80, 443, 53, 123, 8080, 8443, 587, 465, 993, 995, 25]

# Administration ports to protocol name.
ADMIN_PORTS = {22: "SSH", 23: "Telnet", 135: "MS-RPC", 139: "NetBIOS", 445: "SMB",
               3389: "RDP", 5985: "WinRM-HTTP", 5986: "WinRM-HTTPS"}

# Public encrypted-DNS resolvers to provider.
DNS_RESOLVERS = {
    "1.1.1.1": "Cloudflare", "1.0.0.1": "Cloudflare", "1.1.1.2": "Cloudflare",
    "1.0.0.2": "Cloudflare", "1.1.1.3": "Cloudflare", "1.0.0.3": "Cloudflare",
    "8.8.8.8": "Google", "8.8.4.4": "Google",
    "9.9.9.9": "Quad9", "149.112.112.112": "Quad9", "9.9.9.10": "Quad9", "9.9.9.11": "Quad9",
    "94.140.14.14": "AdGuard", "94.140.15.15": "AdGuard", "94.140.14.15": "AdGuard",
    "94.140.15.16": "AdGuard", "208.67.222.222": "OpenDNS", "208.67.220.220": "OpenDNS",
    "185.228.168.9": "CleanBrowsing", "185.228.169.9": "CleanBrowsing",
    "194.242.2.2": "Mullvad", "76.76.2.0": "ControlD", "76.76.10.0": "ControlD",
}

# Well-known destination ports to service label.
PORT_SERVICES = {
    20: "FTP-data", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 67: "DHCP",
    68: "DHCP", 80: "HTTP", 110: "POP3", 123: "NTP", 137: "NetBIOS", 138: "NetBIOS",
    139: "NetBIOS", 143: "IMAP", 161: "SNMP", 389: "LDAP", 443: "HTTPS", 445: "SMB",
    465: "SMTPS", 514: "syslog", 587: "SMTP", 631: "IPP", 853: "DoT", 993: "IMAPS",
    995: "POP3S", 1194: "OpenVPN", 1883: "MQTT", 3306: "MySQL", 3389: "RDP", 5060: "SIP",
    5353: "mDNS", 5432: "PostgreSQL", 5900: "VNC", 6379: "Redis", 8080: "HTTP-alt",
    8443: "HTTPS-alt", 8883: "MQTTS", 9100: "JetDirect", 27017: "MongoDB",
}

# IP protocol numbers and DNS query types with a name.
IP_PROTOCOLS = {1: "icmp", 6: "tcp", 17: "udp"}
DNS_QTYPES = {1: "A", 28: "AAAA", 15: "MX", 16: "TXT", 2: "NS", 5: "CNAME", 12: "PTR"}

# Byte-size buckets, upper bound exclusive, last one open.
BYTE_BUCKETS = [(1_000, "0-1K"), (10_000, "1K-10K"), (100_000, "10K-100K"),
                (1_000_000, "100K-1M"), (10_000_000, "1M-10M")]
BYTE_BUCKET_TOP = "10M+"

# Sudo command fragments that count as sensitive.
SENSITIVE_COMMANDS = ["/bin/su", "/bin/bash", "/usr/bin/python", "passwd", "visudo"]

# Log-line patterns of the authentication log.
AUTH_PATTERNS = {
    "ssh_failure": r"Failed (?:password|publickey|keyboard-interactive) for (?:invalid user )?(\S+) from ([\d.]+)",
    "ssh_invalid_user": r"Invalid user (\S+) from ([\d.]+)",
    "ssh_success": r"Accepted (?:password|publickey|keyboard-interactive) for (\S+) from ([\d.]+)",
    "sudo": r"sudo:.*COMMAND=(.*)",
    "sudo_failure": r"sudo:.*authentication failure",
    "new_user": r"useradd.*new user.*name=(\S+)",
}

# Threat feeds, (kind, category) per feed name.
FEEDS = {"feodo": ("ip", "botnet_c2"),
         "spamhaus_drop": ("cidr", "hijacked_netblock"),
         "urlhaus": ("host", "malware_distribution")}

# Hostname fragment to device type, first match wins.
HOSTNAME_RULES = [
    ("iphone", "phone"), ("ipad", "phone"), ("android", "phone"), ("pixel", "phone"),
    ("galaxy", "phone"), ("oneplus", "phone"), ("macbook", "computer"), ("imac", "computer"),
    ("-mbp", "computer"), ("desktop", "computer"), ("laptop", "computer"),
    ("thinkpad", "computer"), ("printer", "printer"), ("officejet", "printer"),
    ("laserjet", "printer"), ("ipcam", "camera"), ("camera", "camera"), ("doorbell", "camera"),
    ("synology", "nas"), ("diskstation", "nas"), ("qnap", "nas"), ("truenas", "nas"),
    ("nas", "nas"), ("echo", "voice_assistant"), ("alexa", "voice_assistant"),
    ("homepod", "voice_assistant"), ("chromecast", "media_streamer"), ("roku", "media_streamer"),
    ("appletv", "media_streamer"), ("apple-tv", "media_streamer"), ("firetv", "media_streamer"),
    ("shield", "media_streamer"), ("xbox", "game_console"), ("playstation", "game_console"),
    ("ps4", "game_console"), ("ps5", "game_console"), ("nintendo", "game_console"),
    ("raspberrypi", "single_board_computer"), ("raspberry", "single_board_computer"),
    ("rpi", "single_board_computer"), ("router", "router"), ("gateway", "router"),
    ("openwrt", "router"), ("tv", "tv"), ("bravia", "tv"),
]

# Vendor fragment to (device type, confidence), first match wins.
VENDOR_RULES = [
    ("hikvision", "camera", 0.9), ("dahua", "camera", 0.9), ("axis communications", "camera", 0.9),
    ("reolink", "camera", 0.9), ("amcrest", "camera", 0.9), ("wyze", "camera", 0.8),
    ("canon", "printer", 0.7), ("epson", "printer", 0.7), ("brother", "printer", 0.8),
    ("lexmark", "printer", 0.85), ("xerox", "printer", 0.85), ("synology", "nas", 0.9),
    ("qnap", "nas", 0.9), ("western digital", "nas", 0.6), ("ubiquiti", "router", 0.7),
    ("netgear", "router", 0.6), ("tp-link", "router", 0.5), ("d-link", "router", 0.5),
    ("mikrotik", "router", 0.8), ("aruba", "router", 0.7), ("cisco", "router", 0.6),
    ("juniper", "router", 0.7), ("sonos", "voice_assistant", 0.7), ("roku", "media_streamer", 0.9),
    ("vizio", "tv", 0.8), ("lg electronics", "tv", 0.5), ("nintendo", "game_console", 0.9),
    ("sony interactive", "game_console", 0.9), ("raspberry pi", "single_board_computer", 0.9),
    ("espressif", "iot", 0.8), ("tuya", "iot", 0.85), ("shelly", "iot", 0.85),
    ("sonoff", "iot", 0.85), ("signify", "iot", 0.7), ("philips lighting", "iot", 0.7),
    ("ring", "camera", 0.7), ("nest", "iot", 0.6), ("amazon", "iot", 0.5),
    ("apple", "apple_device", 0.5), ("samsung", "phone", 0.35), ("google", "phone", 0.35),
    ("xiaomi", "phone", 0.4), ("huawei", "phone", 0.4), ("intel", "computer", 0.4),
    ("dell", "computer", 0.5), ("hewlett", "computer", 0.35),
]

# Export severities and category lists of the SIEM formats.
SYSLOG_SEVERITY = {"info": 6, "low": 5, "medium": 4, "high": 3, "critical": 2}
CEF_SEVERITY = {"info": 1, "low": 3, "medium": 5, "high": 8, "critical": 10}
ECS_SEVERITY = {"info": 1, "low": 3, "medium": 5, "high": 7, "critical": 9}
OTLP_SEVERITY_NUMBER = {"info": 9, "low": 11, "medium": 13, "high": 17, "critical": 21}
OTLP_SEVERITY_TEXT = {"info": "INFO", "low": "INFO", "medium": "WARN", "high": "ERROR",
                      "critical": "FATAL"}
SYSLOG_FACILITIES = {"user": 1, "daemon": 3, "local0": 16, "local1": 17, "local2": 18,
                     "local3": 19, "local4": 20, "local5": 21, "local6": 22, "local7": 23}
ECS_CATEGORIES = {
    "arp_anomaly": ["network"], "new_device": ["host"],
    "port_scan": ["network", "intrusion_detection"], "beacon": ["network", "intrusion_detection"],
    "connection_anomaly": ["network"], "dns_anomaly": ["network"],
    "lateral_movement": ["network", "intrusion_detection"], "auth_anomaly": ["authentication"],
    "traffic_spike": ["network"], "process_anomaly": ["process"],
    "threat_intel": ["threat", "intrusion_detection"], "honeypot": ["intrusion_detection"],
    "incident": ["intrusion_detection"], "system": ["host"],
}
