"""Encoding repair against Python's codecs."""

import random

from fieldsift.functions import mojibake
from fieldsift.vocab import BROKEN_SEQUENCES, DAMAGE_MARKERS


def test_sequences_are_their_own_utf8_bytes_read_as_a_western_code_page():
    for broken, fixed in BROKEN_SEQUENCES:
        if fixed == "ż" and broken == "Åż":
            continue  # damaged twice: the second character was repaired before
        readings = {fixed.encode().decode("latin-1")}
        try:
            readings.add(fixed.encode().decode("cp1252"))
        except UnicodeDecodeError:
            # A byte without a character is kept as a control character.
            readings.add(
                "".join(
                    bytes([b]).decode("cp1252", "ignore") or chr(b) for b in fixed.encode()
                )
            )
        assert broken in readings


def marker_count(text):
    return sum(text.count(m) for m in DAMAGE_MARKERS)


def second_decoding(text):
    """What a strict decoder makes of the text, keeping it unless damage shrinks."""
    if marker_count(text) == 0:
        return text
    for codec in ("cp1252", "latin-1"):
        try:
            candidate = text.encode(codec).decode("utf-8")
        except UnicodeError:
            pass
        else:
            if marker_count(candidate) < marker_count(text):
                return candidate
    return text


def test_redecode_matches_the_codecs(column):
    rng = random.Random(3)
    words = ["Größe", "München", "ä", "Ä", "łódź", "naïve", "€5", "plain", "…", "“q”", "Ã", "\x81"]
    texts = []
    for _ in range(400):
        text = " ".join(rng.choices(words, k=rng.randint(1, 5)))
        damage = rng.choice(["none", "latin-1", "cp1252", "twice"])
        for codec in {"none": [], "twice": ["latin-1", "latin-1"]}.get(damage, [damage]):
            try:
                text = text.encode().decode(codec)
            except UnicodeDecodeError:
                break
        texts.append(text)
    assert sum(second_decoding(t) != t for t in texts) > 50
    assert column(texts, mojibake.redecode) == [second_decoding(t) for t in texts]

    def repaired(text):
        for broken, fixed in BROKEN_SEQUENCES:
            text = text.replace(broken, fixed)
        return second_decoding(text)

    assert column(texts, mojibake.repair) == [repaired(t) for t in texts]


def test_damage_score_counts_overlapping_markers(column):
    texts = ["Ã Å Ä", "â€“ â€”", "â€ž", "plain", ""]
    assert column(texts, mojibake.damage_score) == [marker_count(t) for t in texts]
    assert marker_count("â€“ â€”") == 4


def test_repair_replaces_then_decodes(column):
    texts = ["WyÅ‚Ä…cznik rÃ³Å¼nicowoprÄ…dowy â€” typ", "GrÃ¶ÃŸe", "Ähnlich", "Ä geht łódź"]
    assert column(texts, mojibake.repair) == [
        "Wyłącznik różnicowoprądowy — typ", "Größe", "Ähnlich", "Ä geht łódź"
    ]
