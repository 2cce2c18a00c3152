from quarry.plans.bloom import bloom_session, fit_filter
from quarry.plans.strategy import RADIX_THRESHOLD, choose, decide, hinted

__all__ = ["RADIX_THRESHOLD", "bloom_session", "choose", "decide", "fit_filter", "hinted"]
