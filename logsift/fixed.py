"""Names, words, patterns, numbers and messages that results depend on.

Everything here is data. The values must stay as they are for results to match; the
logic that uses them lives in the operator modules.
"""

# --- field aliases: target event field <- accepted source keys, first present wins ---
FIELD_ALIASES = {
    "source_ip": ["source_ip", "src", "sourceAddress", "source_address", "src_ip", "SourceIP", "srcAddress", "sourceIpAddress", "sourceIPAddress"],
    "destination_ip": ["destination_ip", "dst", "destinationAddress", "destination_address", "dst_ip", "DestinationIP", "dstAddress"],
    "source_port": ["source_port", "sport", "sourcePort", "source_port_number", "src_port", "SourcePort"],
    "destination_port": ["destination_port", "dport", "dpt", "destinationPort", "destination_port_number", "dst_port", "DestinationPort"],
    "action": ["action", "act", "Action", "eventName", "eventAction"],
    "protocol": ["protocol", "proto", "Protocol", "app"],
    "severity": ["severity", "sev", "Severity", "Level"],
    "timestamp": ["timestamp", "time", "devTime", "TimeCreated", "EventTime", "SystemTime", "date", "eventTime", "creationTime"],
    "event_type": ["event_type", "eventType", "event_name", "name", "event_id", "EventID", "signature_id", "RecordNumber"],
    "user": ["user", "username", "duser", "suser", "userIdentity", "principalId"],
    "hostname": ["hostname", "host", "dhost", "shost", "Computer"],
    "application": ["application", "app", "ProviderName"],
}

# --- fields filled from the first truthy key ---
FALL_THROUGH_FIELDS = {
    "source": ["device_product", "product", "source", "eventSource"],
    "vendor": ["vendor", "device_vendor"],
    "product": ["product", "device_product"],
    "category": ["category", "eventCategory"],
}

# --- parsed keys that never become extensions, besides the aliases above ---
RESERVED_KEYS = [
    "event_id", "timestamp", "source", "vendor", "product", "category", "source_ip", "source_type",
    "source_port", "destination", "destination_ip", "destination_port", "protocol", "event_type",
    "action", "severity", "user", "hostname", "application", "raw_event", "extracted_data", "parser",
    "parser_version", "parse_status", "confidence", "extensions", "metadata",
]

# --- CSV short names copied to their full name when that is absent ---
CSV_ALIASES = {
    "src": "source_ip",
    "dst": "destination_ip",
    "sport": "source_port",
    "dport": "destination_port",
    "proto": "protocol",
    "act": "action",
    "sev": "severity",
}

# --- XML names: target <- candidates, applied only when the target is absent ---
XML_ALIASES = {
    "source_ip": ["source_ip", "src", "SourceAddress", "SourceIP", "src_ip", "IpAddress"],
    "destination_ip": ["destination_ip", "dst", "DestinationAddress", "DestinationIP", "dst_ip"],
    "source_port": ["source_port", "sport", "SourcePort", "src_port"],
    "destination_port": ["destination_port", "dport", "DestinationPort", "dst_port"],
    "action": ["action", "act", "Action"],
    "protocol": ["protocol", "proto", "Protocol"],
    "severity": ["severity", "sev", "Severity", "Level"],
    "timestamp": ["timestamp", "time", "TimeCreated", "EventTime", "SystemTime", "Date"],
    "event_type": ["event_type", "eventType", "EventID", "EventId", "name", "Task"],
}

# --- suggested mappings: target <- words looked for in a key ---
MAPPING_TARGETS = {
    "source_ip": ["src", "src_ip", "sourceaddress", "clientip", "sip", "source"],
    "destination_ip": ["dst", "dst_ip", "destinationaddress", "serverip", "dip", "dest"],
    "source_port": ["spt", "src_port", "sourceport", "sport"],
    "destination_port": ["dpt", "dst_port", "destinationport", "dport", "port"],
    "protocol": ["proto", "protocol"],
    "action": ["act", "action", "status", "outcome"],
    "user": ["usr", "user", "username", "account"],
    "severity": ["sev", "severity", "level"],
}
MAPPING_EXACT_CONFIDENCE = 0.9
MAPPING_PARTIAL_CONFIDENCE = 0.6

# --- format order ---
FORMAT_PRIORITY = {
    "json": 10,
    "aws_cloudtrail": 15,
    "cisco_asa": 15,
    "windows_event": 15,
    "cef": 20,
    "leef": 30,
    "syslog": 40,
    "xml": 50,
    "csv": 60,
}
VENDOR_FORMAT_VERSION = "1.0.0"
WINDOWS_NAMESPACE = "http://schemas.microsoft.com/win/2004/08/events/event"

# --- data quality ---
REQUIRED_FIELDS = ["event_id", "source_type", "raw_event"]
IMPORTANT_FIELDS = ["timestamp", "source_ip", "destination_ip", "action"]
QUALITY_FIELDS = [
    "timestamp", "source_ip", "destination_ip", "source_port", "destination_port", "protocol",
    "event_type", "action", "severity",
]
QUALITY_WEIGHTS = {"completeness": 0.50, "validity": 0.30, "consistency": 0.20}
WARN_MISSING = "Important fields are missing: "
WARN_VALIDITY = "One or more IP/port values are invalid."
WARN_CONSISTENCY = "One or more event fields are inconsistent."

# --- integrity: fields covered by the normalised hash ---
PROTECTED_FIELDS = [
    "event_id", "timestamp", "event_type", "source_ip", "destination_ip", "source_port",
    "destination_port", "user", "hostname", "application", "vendor", "product", "category",
    "severity", "action", "parser", "parser_version", "quality_score", "confidence", "extensions",
    "metadata", "source", "source_type", "destination", "protocol", "device",
]
HASH_VERSION = 2

# --- detection rules ---
FAILED_LOGIN_THRESHOLD = 5
FAILED_LOGIN_WINDOW_SECONDS = 300
SPIKE_THRESHOLD = 100
SPIKE_WINDOW_SECONDS = 60
ANOMALY_BUCKET_SECONDS = 10
ANOMALY_HISTORY = 100
ANOMALY_MIN_SAMPLES = 50
ANOMALY_ZSCORE = 3.0
HTTP_PORTS = [80, 8080, 443, 8443]
SSH_PORT = 22
SUSPICIOUS_COMMANDS = ["rm -rf", "wget", "curl", "nc -e", "base64 -d"]
SEVERITY_POINTS = {"critical": 50, "high": 30, "medium": 15, "low": 5}
RULE_POINTS = 20
FAILED_LOGIN_POINTS = 15
COMMAND_POINTS = 40
ANOMALY_POINTS = 30
RISK_BANDS = [(25, "low"), (50, "medium"), (75, "high")]
RISK_TOP_BAND = "critical"
REASON_NO_BASELINE = "insufficient baseline data"
REASON_FLAT_BASELINE = "zero standard deviation in baseline"

# --- known-format check: format, confidence, reason ---
SUPPORTED_FORMATS = ["syslog", "json", "cef"]
CHECK_REASONS = {
    "cef": "Log starts with the CEF signature 'CEF:'.",
    "json": "Log is valid JSON containing an object.",
    "syslog": "Log starts with a Syslog priority value such as <134>.",
    "vendor-key-value": "Log contains key=value fields but does not match a supported format.",
    "pipe-delimited": "Log contains multiple pipe-separated sections.",
    "xml": "Log appears to contain XML-style tags.",
    "csv-like": "Log contains several comma-separated values.",
}
CHECK_CONFIDENCE = {
    "cef": 1.0, "json": 1.0, "syslog": 1.0, "vendor-key-value": 0.75, "pipe-delimited": 0.70,
    "xml": 0.70, "csv-like": 0.60,
}
REASON_PARSER_KNOWN = "parser successfully recognized the log."
REASON_NO_SIGNATURE = "The log does not match any known format signature."

# --- format classifier: confidence, reason, pattern name ---
CLASSIFIER = {
    "json": (0.95, "Valid JSON object structure detected", "json_structure"),
    "aws_cloudtrail": (0.99, "AWS CloudTrail 'Records' array detected inside JSON", "aws_cloudtrail_json"),
    "cef": (0.98, "CEF signature and header pipe delimiters detected", "cef_header"),
    "cef_partial": (0.60, "CEF signature detected but missing standard fields", "cef_partial"),
    "leef": (0.98, "LEEF signature detected", "leef_header"),
    "syslog": (0.90, "Syslog PRI <PRI> header detected", "syslog_pri"),
    "cisco_asa": (0.95, "Cisco ASA message identifier found in Syslog", "cisco_asa_id"),
    "windows_event": (0.98, "Windows Event XML namespace detected", "windows_xml"),
    "xml": (0.85, "General XML structure detected", "xml_tags"),
    "csv": (0.75, "Comma delimited fields without key-value pairing", "csv_delimiters"),
}
CLASSIFY_EMPTY = ["Empty log provided"]
CLASSIFY_NONE = ["Input does not match any known format signature", "No structural indicators found"]
CLASSIFY_DISABLED = ["Intelligence module is disabled by configuration"]
SUGGEST_THRESHOLD = 0.8

# --- files and queue ---
QUEUE_BATCH = 100

# --- forwarding ---
FORWARD_EVENT_FIELDS = [
    "event_id", "timestamp", "event_type", "source", "source_ip", "source_port", "destination_ip",
    "destination_port", "protocol", "action", "severity", "user", "device", "hostname",
    "application", "vendor", "product", "category", "parser", "parser_version", "quality_score",
    "confidence", "integrity_hash", "previous_hash", "chain_hash", "raw_event",
]
FORWARD_OK = [200, 201, 202, 204]
FORWARD_PERMANENT = [400, 401, 403]
FORWARD_RETRIES = 3
FORWARD_BACKOFF_SECONDS = 2
