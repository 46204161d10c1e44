"""Thresholds and weights. Results depend on them."""

FOUND_SIMILARITY, FOUND_MARGIN, REJECT_BELOW = 0.83, 0.15, 0.55
POOL, VOTE_POOL, TOP_K, MAX_K = 30, 50, 5, 20
SECOND_WEIGHT, MISSING_SIMILARITY = 0.3, -1.0
MATCH_GATE = 0.85
TEXT_WEIGHTS = (0.5, 0.3, 0.2)
EVIDENCE_WEIGHTS, EVIDENCE_INLIERS = (0.4, 0.3, 0.3), 300
RATIO, LEAST_MATCHES = 0.75, 4
TWIN_SIMILARITY, TWIN_LIMIT, AUDIT_SIMILARITY = 0.88, 2000, 0.97
SAFETY = 0.02
CATALOG_ROWS, VARIANT_NAMES, VARIANTS_PER_NAME = 1, 23, 5
COMPLETE = CATALOG_ROWS + VARIANT_NAMES * VARIANTS_PER_NAME
SESSION_TTL_S = 3600
#: Weights of the matching rules.
RULES = {"weight": 3.0, "fat_acid": 2.0, "sweet": 3.5, "tannin": 2.5, "region": 1.0, "aroma": 1.5, "occasion": 1.2, "prefs": 2.5}


def check_thresholds(reject_below: float, found_similarity: float) -> None:
    """The zone of rejection must not reach into the zone of acceptance."""
    if reject_below > found_similarity:
        raise ValueError(f"reject_below {reject_below} exceeds found_similarity {found_similarity}")
