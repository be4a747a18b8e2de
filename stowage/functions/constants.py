"""What is a picture, the class spine, curated synonyms, labels that mean nothing."""

from __future__ import annotations

# Fixed values.
EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "tiff", "tif", "webp", "heic", "heif", "avif", "raw", "cr2", "cr3", "nef", "arw", "dng")

# Code -> (name, sub-categories).
SPINE = {
    100: ("people", {110: "portraits", 120: "groups", 130: "children", 140: "celebrations"}),
    200: ("animals", {210: "pets", 220: "wildlife", 230: "birds"}),
    300: ("places", {310: "urban", 320: "rural", 330: "beach", 340: "mountains", 350: "indoor"}),
    400: ("transportation", {410: "cars", 420: "aircraft", 430: "boats", 440: "trains"}),
    500: ("events", {510: "sports", 520: "concerts", 530: "ceremonies"}),
    600: ("nature", {610: "plants", 620: "landscapes", 630: "weather", 640: "sky"}),
    700: ("documents", {710: "text", 720: "charts", 730: "receipts"}),
    800: ("architecture", {810: "residential", 820: "commercial", 830: "historic"}),
    900: ("miscellaneous", {910: "food", 920: "objects", 930: "abstract"}),
}

# Class -> subjects.
SYNONYMS = {
    "500": ("band", "marching band", "parade", "wedding", "concert", "party", "festival", "graduation", "game", "match"),
    "200": ("dog", "cat", "puppy", "kitten", "horse", "fish"),
    "600": ("sunset", "sunrise", "flower", "tree", "forest", "river", "lake", "waterfall"),
    "400": ("car", "truck", "boat", "plane", "train", "bicycle", "motorcycle"),
    "100": ("baby", "child", "family", "selfie"),
    "700": ("receipt", "document", "sign", "menu"),
    "800": ("house", "building", "church", "bridge"),
    "900": ("food", "meal"),
}

# Fixed values.
DEGENERATE = ("none", "n/a", "na", "unknown", "unclear", "unidentified", "undefined", "misc", "miscellaneous", "other", "others", "various", "general", "untitled", "unlabeled", "unlabelled", "no label", "label")

# Fixed values.
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp"}

FALLBACK_CLASS = "900"
CLASSES = tuple(str(code) for code in SPINE)
DIGEST_LENGTH = 43
NAME_LIMIT = 100
DESCRIPTOR_LIMIT = 30
DESCRIPTOR_WORDS = 3

TRIP_THRESHOLD = 5
BACKOFF_BASE, BACKOFF_FACTOR, BACKOFF_CAP = 60.0, 2.0, 900.0
POISON_LIMIT = 5
POLL_SECONDS = 300.0
LIST_LIMIT = 50


def seed_nodes() -> list[tuple[str, str | None, str]]:
    """(code, parent, label) of the spine, parents first."""
    tops = [(str(code), None, name) for code, (name, _) in SPINE.items()]
    return tops + [(str(sub), str(code), label) for code, (_, subs) in SPINE.items() for sub, label in subs.items()]
