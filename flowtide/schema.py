"""Fixed schema of a flow record and the small dimension tables that go with it."""

from __future__ import annotations

from pyspark.sql import types as T

# The 25 fields of a flow and the capture it came from.  ``flow_bytes_s`` and ``flow_pkts_s``
# are the only measures that keep their nulls.
FLOW_SCHEMA = T.StructType(
    [
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.LongType()),
        T.StructField("dst_port", T.LongType()),
        T.StructField("protocol", T.IntegerType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("flow_duration", T.DoubleType()),
        T.StructField("fwd_pkts", T.DoubleType()),
        T.StructField("bwd_pkts", T.DoubleType()),
        T.StructField("fwd_bytes", T.DoubleType()),
        T.StructField("bwd_bytes", T.DoubleType()),
        T.StructField("flow_bytes_s", T.DoubleType()),
        T.StructField("flow_pkts_s", T.DoubleType()),
        T.StructField("flow_iat_mean", T.DoubleType()),
        T.StructField("flow_iat_std", T.DoubleType()),
        T.StructField("pkt_len_mean", T.DoubleType()),
        T.StructField("pkt_len_std", T.DoubleType()),
        T.StructField("init_win_fwd", T.DoubleType()),
        T.StructField("init_win_bwd", T.DoubleType()),
        T.StructField("syn_count", T.DoubleType()),
        T.StructField("rst_count", T.DoubleType()),
        T.StructField("ack_count", T.DoubleType()),
        T.StructField("fin_count", T.DoubleType()),
        T.StructField("psh_count", T.DoubleType()),
        T.StructField("label", T.StringType()),
        T.StructField("source_file", T.StringType()),
    ]
)

# Measures that take part in median imputation: every double of the record.
NUMERIC_FIELDS = [f.name for f in FLOW_SCHEMA if isinstance(f.dataType, T.DoubleType)]

# Capture header for each field, and the default for a missing number
# (``None`` keeps the null).
CSV_FIELDS = [
    ("src_ip", "Source IP", None),
    ("dst_ip", "Destination IP", None),
    ("src_port", "Source Port", 0),
    ("dst_port", "Destination Port", 0),
    ("protocol", "Protocol", 6),
    ("timestamp", "Timestamp", None),
    ("flow_duration", "Flow Duration", 0.0),
    ("fwd_pkts", "Total Fwd Packets", 0.0),
    ("bwd_pkts", "Total Backward Packets", 0.0),
    ("fwd_bytes", "Total Length of Fwd Packets", 0.0),
    ("bwd_bytes", "Total Length of Bwd Packets", 0.0),
    ("flow_bytes_s", "Flow Bytes/s", None),
    ("flow_pkts_s", "Flow Packets/s", None),
    ("flow_iat_mean", "Flow IAT Mean", 0.0),
    ("flow_iat_std", "Flow IAT Std", 0.0),
    ("pkt_len_mean", "Packet Length Mean", 0.0),
    ("pkt_len_std", "Packet Length Std", 0.0),
    ("init_win_fwd", "Init_Win_bytes_forward", 0.0),
    ("init_win_bwd", "Init_Win_bytes_backward", 0.0),
    ("syn_count", "SYN Flag Count", 0.0),
    ("rst_count", "RST Flag Count", 0.0),
    ("ack_count", "ACK Flag Count", 0.0),
    ("fin_count", "FIN Flag Count", 0.0),
    ("psh_count", "PSH Flag Count", 0.0),
    ("label", "Label", None),
]

# Tokens a capture writes where it has no number.
INFINITY_TOKENS = ["Infinity", "+Infinity"]
NEG_INFINITY_TOKENS = ["-Infinity"]
NAN_TOKENS = ["NaN", "nan"]
NULL_TOKENS = ["Infinity", "-Infinity", "+Infinity", "NaN", "nan", "null", ""]

# Raw capture label -> operational class.
LABEL_CLASSES = {
    "BENIGN": "BENIGN",
    "PortScan": "RECONNAISSANCE",
    "FTP-Patator": "BRUTE_FORCE",
    "SSH-Patator": "BRUTE_FORCE",
    "Web Attack - Brute Force": "BRUTE_FORCE",
    "Web Attack - XSS": "WEB_EXPLOIT",
    "Web Attack - Sql Injection": "WEB_EXPLOIT",
    "DoS Hulk": "DENIAL_OF_SERVICE",
    "DoS GoldenEye": "DENIAL_OF_SERVICE",
    "DoS slowloris": "DENIAL_OF_SERVICE",
    "DoS Slowhttptest": "DENIAL_OF_SERVICE",
    "DDoS": "DENIAL_OF_SERVICE",
    "Heartbleed": "DENIAL_OF_SERVICE",
    "Bot": "BOTNET",
    "Infiltration": "INFILTRATION",
}

# Class index is the position in this list.
CLASS_NAMES = [
    "BENIGN",
    "RECONNAISSANCE",
    "BRUTE_FORCE",
    "WEB_EXPLOIT",
    "DENIAL_OF_SERVICE",
    "BOTNET",
    "INFILTRATION",
]
N_CLASSES = len(CLASS_NAMES)
BENIGN_INDEX = 0

# Most severe first; a window takes the first class it contains.
SEVERITY = [
    "INFILTRATION",
    "WEB_EXPLOIT",
    "BRUTE_FORCE",
    "BOTNET",
    "RECONNAISSANCE",
    "DENIAL_OF_SERVICE",
    "BENIGN",
]

WINDOW_KEY = ["source_file", "window_idx"]

WINDOW_FEATURES = [
    "flow_count",
    "total_bytes",
    "total_pkts",
    "syn_ratio",
    "rst_ratio",
    "mean_duration",
    "n_unique_src",
    "n_unique_dst",
]

EDGE_FEATURES = [
    "flow_count",
    "total_bytes",
    "total_pkts",
    "mean_duration",
    "mean_iat",
    "syn_count",
    "dst_port_entropy",
]

NODE_FEATURES = [
    "in_degree",
    "out_degree",
    "in_bytes",
    "out_bytes",
    "in_pkts",
    "out_pkts",
    "syn_ratio",
    "rst_ratio",
    "peer_count",
]

KNOWLEDGE_FIELDS = [
    "tactic",
    "tactic_id",
    "technique",
    "technique_id",
    "security_description",
    "recommended_soc_action",
]

# Class -> (tactic, tactic id, technique, technique id, description, action).
KNOWLEDGE = {
    "BENIGN": (
        "Normal Operations",
        "TA0000",
        "Authorized Enterprise Traffic",
        "T0000",
        "Baseline background traffic consistent with standard enterprise workflows.",
        "Maintain continuous passive monitoring.",
    ),
    "RECONNAISSANCE": (
        "Reconnaissance",
        "TA0043",
        "Network Service Discovery",
        "T1046",
        "Adversary attempting to discover active hosts, open ports, and vulnerable services.",
        "Rate-limit probing IPs, inspect firewall logs for horizontal port sweeps, enforce IDS drop rules.",
    ),
    "BRUTE_FORCE": (
        "Credential Access",
        "TA0006",
        "Brute Force: Password Guessing / Password Spraying",
        "T1110",
        "Systematic guessing of credentials against remote services (SSH, FTP, Web authentication endpoints).",
        "Enforce account lockouts, deploy fail2ban / rate-limiting, enforce multi-factor authentication (MFA).",
    ),
    "WEB_EXPLOIT": (
        "Initial Access",
        "TA0001",
        "Exploit Public-Facing Application",
        "T1190",
        "Targeting flaws in web applications (SQL Injection, Cross-Site Scripting) to execute malicious inputs.",
        "Inspect WAF alerts, sanitize application queries, validate input encoding, isolate target web server.",
    ),
    "DENIAL_OF_SERVICE": (
        "Impact",
        "TA0040",
        "Network Denial of Service: Direct Network Flood",
        "T1498",
        "Flooding network boundaries with voluminous traffic or resource-exhaustion requests (SYN floods, slowloris).",
        "Engage upstream DDoS scrubbing, enable SYN cookies, rate-limit ingress UDP/TCP connections.",
    ),
    "BOTNET": (
        "Command and Control",
        "TA0011",
        "Application Layer Protocol: Web Protocols",
        "T1071.001",
        "Internal host communicating with external command and control (C2) server or participating in coordinated botnet activity.",
        "Quarantine infected endpoint, sinkhole C2 destination IP, perform memory forensics on affected host.",
    ),
    "INFILTRATION": (
        "Lateral Movement / Exfiltration",
        "TA0008",
        "Remote Services / Lateral Tool Transfer",
        "T1021 / T1570",
        "Post-compromise pivot into internal network segments, lateral credential reuse, or stealthy data movement.",
        "Sever internal segmentation bridge, revoke active Kerberos/NTLM sessions, audit internal pivot paths.",
    ),
}
