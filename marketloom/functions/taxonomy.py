"""Fixed domains of the event schema."""

# Event types.
EVENT_TYPES = (
    "eps_surprise", "revenue_surprise", "guidance_change", "margin_change",
    "management_commentary", "acquisition", "divestiture", "buyback", "offering",
    "leadership_change", "regulatory_approval", "investigation", "lawsuit", "policy_change",
    "product_launch", "major_contract", "partnership", "technical_breakthrough", "fed",
    "cpi_inflation", "jobs", "rates", "geopolitical", "upgrade", "downgrade",
    "price_target_change", "unknown")

# Directions with their numeric value.
DIRECTIONS = {"positive": 1.0, "negative": -1.0, "neutral": 0.0, "unknown": 0.0}

# Admissible origins of an expectation, and the keys a surprise must carry.
SURPRISE_SOURCES = ("article_text", "company_guidance")
SURPRISE_KEYS = ("metric", "expected", "actual", "surprise_pct", "expectation_source")

# Decay constants in minutes.
DECAY_MINUTES = {"tau_30m": 30.0, "tau_2h": 120.0, "tau_1d": 1440.0}

# Confidence of a matched keyword rule and of no match.
RULE_CONFIDENCE, NO_MATCH_CONFIDENCE = 0.55, 0.0
