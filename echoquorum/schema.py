"""Table schemas, enumerations and thresholds of the engine."""

from __future__ import annotations

import math

from pyspark.sql import types as T

# Thresholds, weights and enumerations that results depend on.
MIN_CONFIDENCE = 0.70
CANONICAL_CONFIDENCE = 0.85
SCREEN_MARGIN = 0.10
OVERLAP_THRESHOLD = 0.70
IDENTIFY_MIN_SCORE = 0.15
IDENTIFY_CANDIDATES = 8
W_RARITY, W_OVERLAP, W_TEMPORAL = 0.5, 0.3, 0.2
MIN_RUN = 3
FLAG_AFTER = 3
RATE_LIMIT, RATE_SECONDS = 600, 60
MAX_TITLES = 500
TIERS = ["candidate", "confirmed", "canonical"]
VERDICTS = ["pass", "pending", "flag_conflict", "flag_duplicate"]
MATCH_SOURCES = ["engram_asr", "engram_discdb", "bootstrap", "user_review", "engram_chromaprint_corroboration", "network_disc"]
ASR, DISCDB, BOOTSTRAP, USER_REVIEW, _, NETWORK_DISC = MATCH_SOURCES
ASSIGNMENTS = ["episode", "main_movie", "extra", "discarded"]
CONTENT_TYPES = ["tv", "movie"]
UUID4 = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
BASE64 = r"^[A-Za-z0-9+/]*={0,2}\z"

EPISODE = ["tmdb_id", "season", "episode"]
#: The column in which readers keep the text of a request that they can't read.
UNREADABLE = "_corrupt_record"


_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "longs": T.ArrayType(T.LongType())}


def _fields(text: str) -> T.StructType:
    """A struct type from "name type, ..."; needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (f.split() for f in text.split(","))])


# Names and types of the fields of tables and requests.
TITLE = _fields(
    "title_index int, duration_seconds int, size_bytes long, assignment string, season int, episode int, match_confidence double, match_source string"
)
CONTRIBUTION_REQUEST = _fields(
    "wire_format_version int, pseudonym string, tmdb_id long, season int, episode int, fingerprint_b64 string, "
    "fingerprint_sha256_b64 string, disc_content_hash_b64 string, match_confidence double, match_source string, client_version string"
)
DISC_REQUEST = _fields(
    "wire_format_version int, pseudonym string, disc_content_hash_b64 string, tmdb_id long, content_type string, season int"
).add("titles", T.ArrayType(TITLE)).add("client_version", T.StringType())
CONTRIBUTION = _fields(
    "id long, received_at long, pseudonym string, tmdb_id long, season int, episode int, fingerprint binary, fingerprint_sha256 binary, "
    "disc_content_hash binary, match_confidence double, match_source string, client_version string, poison_check string, promoted_at long, ingress_host string"
)
CONTRIBUTOR = _fields("pseudonym string, first_seen long, last_seen long, contribution_count long, flagged int, flag_count long")
EPISODE_CANONICAL = _fields(
    "tmdb_id long, season int, episode int, tier string, fingerprint binary, unique_contributors long, mean_confidence double, promoted_at long"
)
CANONICAL_SKETCH = _fields("tmdb_id long, season int, episode int, sketch binary, hash_count int, generated_at long")
OVERLAP_OBSERVATION = _fields(
    "contribution_id long, max_overlap_pct double, target_tmdb_id long, target_season int, target_episode int, candidates_checked long, computed_at long"
)
DISC_CONTRIBUTION = _fields(
    "id long, received_at long, pseudonym string, disc_content_hash binary, tmdb_id long, content_type string, season int, "
    "titles_json string, titles_digest string, client_version string, ingress_host string, promoted_at long"
)
DISC_CANONICAL = _fields(
    "disc_content_hash binary, tmdb_id long, content_type string, season int, titles_json string, titles_digest string, tier string, "
    "unique_contributors long, mean_confidence double, promoted_at long"
)
SEED = _fields("tmdb_id long, season int, episode int, hashes longs")
RETRACTION = _fields("wire_format_version int, pseudonym string, tmdb_id long, season int, episode int, fingerprint_sha256_b64 string")


def check_threshold(value: float) -> float:
    """An overlap threshold must be finite and in [SCREEN_MARGIN, 1)."""
    if not (isinstance(value, (int, float)) and math.isfinite(value) and SCREEN_MARGIN <= value < 1):
        raise ValueError(f"overlap threshold {value!r} is not in [{SCREEN_MARGIN}, 1)")
    return float(value)


def check_min_score(value: float) -> float:
    if not (isinstance(value, (int, float)) and math.isfinite(value)):
        raise ValueError(f"minimum score {value!r} is not a number")
    return float(value)


def clamp_k(k: float | None) -> int:
    """Number of candidates: 5 unless a positive number is given, from 1 to 20."""
    if k is None or not math.isfinite(k) or k <= 0:
        return 5
    return int(max(1, min(20, k)))


def clamp_page(limit: int | None, offset: int | None) -> tuple[int, int]:
    limit = 200 if limit is None else max(1, min(500, int(limit)))
    return limit, max(0, int(offset or 0))
