"""Word lists of the group that runs the review, from `resources/groups.yaml`."""

from __future__ import annotations

from importlib import resources

import yaml

_FOUND = yaml.safe_load(resources.files("gatehouse.resources").joinpath("groups.yaml").read_text(encoding="utf-8"))

#: (word of the supplier type, name of the category)
SPECIAL_CATEGORIES = [(row["word"], row["name"]) for row in _FOUND["special_categories"]]
RELATED_WORDS = list(_FOUND["related_words"])
