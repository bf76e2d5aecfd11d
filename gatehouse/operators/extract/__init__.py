from .certificates import page_texts  # noqa: F401
from .confidence import confidence_distribution, confidence_review  # noqa: F401
from .dispatch import extract_all, shared_results, to_extract  # noqa: F401
