"""Closed inventories of the domain.  All of these are fixed values: results depend on them exactly."""

from __future__ import annotations

ROLES = ("viewer", "analyst", "approver", "admin")

STATUTE_TYPES = ("law", "decree", "enforcement_rule")
DOC_CATEGORIES = ("statute", "admin_rule", "statute_annex", "admin_rule_annex", "feed", "other")

STANDARD_STATUSES = ("recognized", "harmonized", "withdrawn", "superseded", "unknown")
NON_SUBSTANTIVE_KINDS = ("renumbered", "moved")

DAY = 86_400
POLL_SECONDS = {
    "primary_laws": DAY, "regulations": DAY, "registration": DAY, "ingredient": DAY, "standards": DAY,
    "gmp": 7 * DAY, "safety": DAY, "guidance": 7 * DAY, "official_sources": 7 * DAY,
}
TIER_FLOOR_SECONDS = {"a": 0, "b": 0, "c": DAY, "d": 30 * DAY}

COUNT_DRIFT_RATIO = 0.5
RENUMBER_RATIO = 0.60
RENUMBER_CONFIDENT_RATIO = 0.90
SIMILARITY_PREFIX = 2048

DISCOVERY_KEYWORDS = {
    "mfds_samd": ("의료기기", "디지털의료제품", "인체적용제품"),
    "mfds_cosmetic": ("화장품", "색소", "인체적용제품"),
}
DISCOVERY_EXCLUSIONS = ("체외진단", "범부처", "감시원", "의료기기위원회", "자격시험", "교육실시기관")
CREDENTIAL_PARAMS = ("OC", "oc", "key", "apikey", "api_key")
CREDENTIAL_PLACEHOLDER = "{OC}"
VOLATILE_FIELDS = ("조회수", "조회 수", "hit", "hits", "viewcount", "view_count", "readcount")

MODALS = {
    "ko": {
        "하여야 한다": r"하여야\s*(?:한다|하며|하고|하는|할|함)",
        "해야 한다": r"해야\s*(?:한다|하며|하고|하는|할|함)",
        "도록 한다": r"도록\s*(?:한다|하며|하고|하여야)",
        "금지한다": r"금지(?:한다|하며|된다|되며)",
        "아니 된다": r"아니\s*(?:된다|되며|하다)",
    },
    "en": {
        "shall": r"\bshall\b(?!\s+not\s+be\s+construed)",
        "must": r"\bmust\b",
        "is required to": r"\b(?:is|are)\s+required\s+to\b",
        "may not": r"\bmay\s+not\b",
    },
}
PERMISSIVE = {"ko": r"할\s*수\s*있다|수\s*있다", "en": r"\bmay\b(?!\s+not)|\bcan\b|\bis\s+permitted\s+to\b"}
TAXONOMY = {"samd": ("design_control", "risk", "vnv", "postmarket"), "cosmetic": ("ingredient", "labelling", "claims", "gmp", "notification")}

MAX_PASSAGE_CHARS = 1200
CANDIDATES = 40
TOP_K = 8
RRF_K = 60
LEXICAL_WEIGHT, VECTOR_WEIGHT, ROW_WEIGHT, EXACT_WEIGHT = 1.2, 1.0, 1.2, 1.2
IDENTIFIER_BOOST = 100.0

CONFIDENCE_THRESHOLD = 0.7
VERIFICATION_WEIGHT, RETRIEVAL_WEIGHT = 0.7, 0.3
VERDICT_WEIGHTS = {"supported": 1.0, "partial": 0.5, "unsupported": 0.0}
MAX_CLAIMS = 12
MAX_CITABLE = 24

SEVERITIES = ("low", "medium", "high")
BULK_CLAUSES = 20
DELIVERY_ATTEMPTS, BACKOFF_BASE, BACKOFF_CAP = 5, 60, 21_600
TIMEZONES = {"mfds": "Asia/Seoul", "fda": "America/New_York", "eu": "Europe/Brussels", "nmpa": "Asia/Shanghai"}
AUDIT_GENESIS = "0" * 64

AXES = ("identifier", "conceptual", "effective_date", "mis_citation", "cross_domain", "unanswerable")
GATES = {
    "detection_coverage": ("min", 0.95), "detection_latency_hours": ("max", 24.0), "citation_accuracy": ("min", 0.90),
    "hallucination_rate": ("max", 0.02), "time_saving": ("min", 0.30), "pilot_retention": ("min", 0.60),
}
NO_GO_FAILURES = 4
AGREEMENT_FLOOR = 0.80
