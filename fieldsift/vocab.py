"""Default vocabularies of the extraction operators.

Every operator takes a :class:`Vocabulary`, so a job can swap word lists without
touching code.  The defaults are fixed values: results only agree with the
documented behaviour when they are spelled exactly like this.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: field labels, tried in this order -------------------------
MATERIAL_LABELS = (
    "material type",
    "typ materialu",
    "rodzaj materialu",
    "nazwa materialu",
    "material",
    "produkt",
)
DESCRIPTION_LABELS = ("description", "opis")

# --- fixed values: section markers and the markers that end a section --------
SECTION_MARKERS = ("opis produktu",)
SECTION_STOPS = (
    "zastosowanie",
    "obrobka",
    "obróbka",
    "dane techniczne",
    "wlasciwosci",
    "właściwości",
)
TITLE_STOPS = (
    "europejska ocena techniczna",
    "deklaracja wlasciwosci uzytkowych",
    "deklaracja właściwości użytkowych",
    "zamierzone zastosowanie",
)

# --- fixed values: lines that can never be a material type -------------------
EXCLUDED_PREFIXES = (
    "manufacturer",
    "producent",
    "description",
    "opis",
    "material type",
    "typ",
)
EXCLUDED_HEADERS = (
    "specyfikacja techniczna",
    "architektura",
    "bezpieczenstwo",
    "bezpieczeństwo",
)
NOISE_PHRASES = (
    "karta materialowa",
    "karta produktu",
    "deklaracja właściwości użytkowych",
    "dokumentacja techniczna",
    "strona tytulowa",
    "strona tytułowa",
)

# --- fixed values: declarations of performance -------------------------------
DECLARATION_PHRASE = "deklaracja właściwości użytkowych"
DECLARATION_SKIPPED_PREFIXES = ("nr ", "producent:", "zamierzone zastosowanie")
DECLARATION_CODE_PREFIX = "niepowtarzalny kod identyfikacyjny typu wyrobu"

# --- fixed values: words that make a line look like a product ----------------
MATERIAL_KEYWORDS = (
    "adhesive",
    "board",
    "cable",
    "cement",
    "facade",
    "fire",
    "insulation",
    "mortar",
    "panel",
    "kabel",
    "plyta",
    "płyta",
    "przewod",
    "przewód",
    "roznicowopradowy",
    "różnicowoprądowy",
    "wylacznik",
    "wyłącznik",
    "zaprawa",
)
EXTRA_DESCRIPTION_NOISE = ("dane techniczne", "technical data")
EXTRA_DESCRIPTION_KEYWORDS = (
    "assemblies",
    "commercial",
    "elewacyjnych",
    "etics",
    "external",
    "komercyjnych",
    "mieszkaniowych",
    "mocowania",
    "montażu",
    "powierzchniach",
    "rozdzielnicach",
    "stosowania",
    "systems",
    "zatapiania",
)

# --- fixed values: encoding damage (broken sequence -> intended character) ---
# The order matters: longer sequences come before their own prefixes.
BROKEN_SEQUENCES = (
    ("â€”", "—"),
    ("â€“", "–"),
    ("â€ž", "„"),
    ("â€œ", "“"),
    ("â€\u009d", "”"),
    ("â€™", "’"),
    ("Å‚", "ł"),
    ("Å\u0081", "Ł"),
    ("Ä…", "ą"),
    ("Ä„", "Ą"),
    ("Ä‡", "ć"),
    ("Ä†", "Ć"),
    ("Ä™", "ę"),
    ("Ä˜", "Ę"),
    ("Å„", "ń"),
    ("Åƒ", "Ń"),
    ("Ã³", "ó"),
    ("Ã“", "Ó"),
    ("Å›", "ś"),
    ("Åš", "Ś"),
    ("Å¼", "ż"),
    ("Åż", "ż"),
    ("Å»", "Ż"),
    ("Åº", "ź"),
    ("Å¹", "Ź"),
)
DAMAGE_MARKERS = (
    "Ã",
    "Å",
    "Ä",
    "â€",
    "â€“",
    "â€”",
)

# --- fixed values: texts of the output --------------------------------------
DESCRIPTION_PLACEHOLDER = "Brak opisu w dokumentacji"
ATTACHMENTS_PLACEHOLDER = "—"


@dataclass(frozen=True)
class Vocabulary:
    """Word lists used by extraction; each one can be replaced on its own."""

    material_labels: tuple[str, ...] = MATERIAL_LABELS
    description_labels: tuple[str, ...] = DESCRIPTION_LABELS
    section_markers: tuple[str, ...] = SECTION_MARKERS
    section_stops: tuple[str, ...] = SECTION_STOPS
    title_stops: tuple[str, ...] = TITLE_STOPS
    excluded_prefixes: tuple[str, ...] = EXCLUDED_PREFIXES
    excluded_headers: tuple[str, ...] = EXCLUDED_HEADERS
    noise_phrases: tuple[str, ...] = NOISE_PHRASES
    declaration_phrase: str = DECLARATION_PHRASE
    declaration_skipped_prefixes: tuple[str, ...] = DECLARATION_SKIPPED_PREFIXES
    declaration_code_prefix: str = DECLARATION_CODE_PREFIX
    material_keywords: tuple[str, ...] = MATERIAL_KEYWORDS
    description_noise: tuple[str, ...] = NOISE_PHRASES + EXTRA_DESCRIPTION_NOISE
    description_keywords: tuple[str, ...] = MATERIAL_KEYWORDS + EXTRA_DESCRIPTION_KEYWORDS
    broken_sequences: tuple[tuple[str, str], ...] = BROKEN_SEQUENCES
    damage_markers: tuple[str, ...] = DAMAGE_MARKERS
    description_placeholder: str = DESCRIPTION_PLACEHOLDER


DEFAULT_VOCABULARY = Vocabulary()
