"""Fixed values.

Everything below is data that results depend on: names, class ids, alias words, limits and
message formats. It is kept together and in its natural order; no logic lives here.
"""

# --- features -------------------------------------------------------------------------------
V1_FEATURES = (
    "PROTOCOL",
    "L7_PROTO",
    "IN_BYTES",
    "OUT_BYTES",
    "IN_PKTS",
    "OUT_PKTS",
    "TCP_FLAGS",
    "FLOW_DURATION_MILLISECONDS",
)

V2_EXTRA_FEATURES = (
    "CLIENT_TCP_FLAGS",
    "SERVER_TCP_FLAGS",
    "DURATION_IN",
    "DURATION_OUT",
    "MIN_TTL",
    "MAX_TTL",
    "LONGEST_FLOW_PKT",
    "SHORTEST_FLOW_PKT",
    "MIN_IP_PKT_LEN",
    "MAX_IP_PKT_LEN",
    "SRC_TO_DST_SECOND_BYTES",
    "DST_TO_SRC_SECOND_BYTES",
    "RETRANSMITTED_IN_BYTES",
    "RETRANSMITTED_IN_PKTS",
    "RETRANSMITTED_OUT_BYTES",
    "RETRANSMITTED_OUT_PKTS",
    "SRC_TO_DST_AVG_THROUGHPUT",
    "DST_TO_SRC_AVG_THROUGHPUT",
    "NUM_PKTS_UP_TO_128_BYTES",
    "NUM_PKTS_128_TO_256_BYTES",
    "NUM_PKTS_256_TO_512_BYTES",
    "NUM_PKTS_512_TO_1024_BYTES",
    "NUM_PKTS_1024_TO_1514_BYTES",
    "TCP_WIN_MAX_IN",
    "TCP_WIN_MAX_OUT",
    "ICMP_TYPE",
    "ICMP_IPV4_TYPE",
    "DNS_QUERY_ID",
    "DNS_QUERY_TYPE",
    "DNS_TTL_ANSWER",
    "FTP_COMMAND_RET_CODE",
)

# Columns of a raw flow table that are not features.
ADDRESS_COLUMNS = ("IPV4_SRC_ADDR", "L4_SRC_PORT", "IPV4_DST_ADDR", "L4_DST_PORT")
ATTACK_COLUMN = "Attack"
LABEL_COLUMN = "Label"
DATASET_COLUMN = "Dataset"

# --- attack classes ---------------------------------------------------------------------------
V1_CLASS_IDS = {
    "Benign": 0,
    "DDoS": 1,
    "DoS": 2,
    "Reconnaissance": 3,
    "Theft": 4,
}

V2_CLASS_IDS = {
    "Benign": 0,
    "DDoS": 1,
    "DoS": 2,
    "Reconnaissance": 3,
    "Theft": 4,
    "Backdoor": 5,
    "Injection": 6,
    "Password": 7,
    "Ransomware": 8,
    "XSS": 9,
    "MITM": 10,
}

CLASS_ALIASES = {
    "benign": "Benign",
    "ddos": "DDoS",
    "dos": "DoS",
    "reconnaissance": "Reconnaissance",
    "scanning": "Reconnaissance",
    "port_scan": "Reconnaissance",
    "theft": "Theft",
    "data_theft": "Theft",
    "backdoor": "Backdoor",
    "injection": "Injection",
    "password": "Password",
    "ransomware": "Ransomware",
    "xss": "XSS",
    "mitm": "MITM",
    "unknown": "Unknown",
}

UNKNOWN_CLASS = "Unknown"
UNKNOWN_CLASS_ID = -1
BENIGN_CLASS = "Benign"

# --- detectors: name, dataset version, model type ---------------------------------------------
AGENT_ROWS = (
    ("agent_1_xgboost_v1", "v1", "xgboost"),
    ("agent_2_xgboost_v2", "v2", "xgboost"),
    ("agent_3_lstm_v1", "v1", "lstm"),
    ("agent_4_lstm_v2", "v2", "lstm"),
    ("agent_5_rf_v1", "v1", "random_forest"),
    ("agent_6_rf_v2", "v2", "random_forest"),
    ("agent_7_unknown", "both", "autoencoder"),
)

PARTICIPATION_SHARE = 0.8
DEFAULT_CONFIDENCE = 0.8
NEURAL_CUT = 0.5

# --- sampling and splitting --------------------------------------------------------------------
SEED = 42
TEST_SHARE = 0.2
RARE_CLASSES = ("ransomware", "injection", "xss", "mitm", "password", "backdoor")
COMMON_CLASSES = ("ddos", "dos", "scanning")
RARE_CAP = 5000
COMMON_CAP = 2000
BENIGN_CAP = 5000
SMART_SAMPLE_SIZE = 50000
BACKGROUND_ROWS = 50

# --- explanations -------------------------------------------------------------------------------
TOP_FEATURES = 5
TEXT_FEATURES = 3
# name fragment, factor, format of the indicator; tested in this order
RAW_VALUE_RULES = (
    ("PKTS", 1000, " (Actual: %s normalized, ~%s packets estimated)", 4),
    ("BYTES", 100000, " (Actual: %s normalized, ~%s bytes estimated)", 6),
    ("DURATION", 10000, " (Actual: %s normalized, ~%sms estimated)", 6),
)
RAW_VALUE_DEFAULT = " (Actual value: %s)"
INDICATOR_FORMAT = "%s: %s%% contribution, SHAP value: %s%s"

NO_FEATURES_TEXT = "No significant features identified."
AGENT_TEXT_HEAD = "%s detected anomaly based on:\n"
AGENT_TEXT_LINE = "%s. %s (%s anomaly score by %s)\n"
ENSEMBLE_TEXT_HEAD = "Ensemble Decision: %s\nKey Contributing Factors:\n"
ENSEMBLE_TEXT_LINE = "%s. %s (importance: %s)\n"

BRIEFING_EMPTY = "System classified this as %s with %s%% confidence."
BRIEFING_BENIGN = (
    "**Analysis:** Traffic classified as BENIGN (%s%% confidence). Top indicators: %s.\n"
    "**Status:** No threat detected.\n"
    "**Action:** Continue monitoring."
)
BRIEFING_ANOMALY = (
    "**Threat Assessment:** ANOMALY detected (%s%% confidence). Key indicators: %s.\n"
    "**Immediate Actions:**\n"
    "1. Block source IP\n"
    "2. Investigate traffic patterns\n"
    "3. Document incident\n"
    "**Forensics:**\n"
    "• Capture PCAP\n"
    "• Check threat intel"
)

NO_PARTICIPANTS_ERROR = "No agents can participate with available features"

# --- question answers: every group needs one of its words; the first rule that fits answers -------
ANSWER_RULES = (
    (
        "why",
        (("why",), ("anomaly", "attack")),
        "The system detected this as an anomaly based on multiple factors: unusual traffic patterns, "
        "high confidence from tree-based models (XGBoost and Random Forest), and SHAP analysis showing "
        "that features like PROTOCOL, IN_BYTES, and TCP_FLAGS had significant importance in the decision.",
    ),
    (
        "agents",
        (("agent",),),
        "The multi-agent system uses 7 specialized AI agents: XGBoost (V1 & V2), LSTM (V1 & V2), Random "
        "Forest (V1 & V2), and an Autoencoder for unknown attacks. Each agent votes based on its "
        "confidence, and the final decision is made through weighted ensemble voting.",
    ),
    (
        "actions",
        (("what",), ("do",)),
        "Recommended actions: 1) Investigate the source IP and destination, 2) Check for similar patterns "
        "in recent traffic, 3) Review firewall rules, 4) Consider blocking the source if confirmed "
        "malicious, 5) Document the incident for future reference.",
    ),
    (
        "false_positive",
        (("false positive",),),
        "To determine if this is a false positive: 1) Check if the traffic pattern matches known "
        "legitimate applications, 2) Verify the source and destination are trusted, 3) Look at historical "
        "data for this endpoint, 4) Consider the confidence score - lower confidence may indicate "
        "uncertainty.",
    ),
    (
        "features",
        (("feature", "important"),),
        "The most important features in this detection were identified through SHAP analysis. These "
        "typically include PROTOCOL (network protocol type), IN_BYTES/OUT_BYTES (data volume), TCP_FLAGS "
        "(connection state), and FLOW_DURATION (how long the connection lasted). Unusual values in these "
        "features often indicate attacks.",
    ),
)
ANSWER_DEFAULT_HEAD = "I understand you're asking about: '"
ANSWER_DEFAULT_TAIL = (
    "'. The detection system uses ensemble learning with 7 AI agents to analyze network traffic. Each "
    "agent examines different aspects of the traffic pattern, and their votes are combined to make the "
    "final decision. The SHAP explainability module shows which features were most important in the "
    "decision."
)

# --- monitor ---------------------------------------------------------------------------------------
LATEST_POINTS = 20
ALERT_FORMAT = "⚠️ %s DETECTED! Confidence: %s%%"
ALERT_UNNAMED = "ANOMALY"
