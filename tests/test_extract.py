"""Expected fields of known texts."""

import pytest
from pyspark.sql import functions as F

from fieldsift.operators.extract import extract_fields
from fieldsift.vocab import Vocabulary

HEATER = "Kabel grzejny samoregulujący do rynien 18W/m 230V"

# name: (text, material type, description)
GOLDEN = {
    "labels": (
        "ARKUSZ DANYCH\nDział podłóg\n\nMaterial type: Cork floor underlay\n"
        "Description: Elastic underlay for laminate floors.\n\nManufacturer: Korek Dom\n",
        "Cork floor underlay",
        "Elastic underlay for laminate floors",
    ),
    "wrapped": (
        "WYKAZ SCHODOW\nCzesc druga\n\nMaterial type: Folding oak staircase\nwith handrail "
        "for attics\nand lofts\nDescription: Insulated hatch with three\nladder sections.\n\n"
        "Order no: ST-9\n",
        "Folding oak staircase with handrail for attics and lofts",
        "Insulated hatch with three ladder sections",
    ),
    "ranked": (
        f"KG18R\n{HEATER}\nTyp R\nSpecyfikacja techniczna\nNapiecie zasilania 230V\n",
        HEATER,
        HEATER,
    ),
    "ranked description": (
        "LISTA WYROBOW\nMaterial type: Cement floor screed\nDo wyrownania podlog pod plytki "
        "oraz montażu listew\nprzy powierzchniach zewnetrznych i rurach drenażu.\n"
        "Schnie okolo 12 godzin.\n",
        "Cement floor screed",
        "Do wyrownania podlog pod plytki oraz montażu listew przy powierzchniach zewnetrznych "
        "i rurach drenażu",
    ),
    "missing": (
        "Producent: Lumen Wschód\nDescription: Ceiling lamp for halls.\n"
        "Specyfikacja techniczna\nOpis: Lampa sufitowa do hal.\nTyp: LW-3\n",
        None,
        None,
    ),
    "noise before a title": (
        "STRONA TYTUŁOWA\nDOKUMENTACJA TECHNICZNA\nOak veneered door panel for dry interior "
        "rooms\nSpecyfikacja techniczna\n",
        "Oak veneered door panel for dry interior rooms",
        "Oak veneered door panel for dry interior rooms",
    ),
    "codes before a title": (f"KG18R\nST-9\n{HEATER}\nTyp R\n", HEATER, HEATER),
    "cover page": (
        "STRONA TYTULOWA\nKARTA MATERIALOWA\nAcrylic mortar for joints of terrace tiles\n"
        "Schnie okolo 12 godzin\n",
        "Acrylic mortar for joints of terrace tiles",
        "Acrylic mortar for joints of terrace tiles",
    ),
    "description after a header": (
        f"KARTA PRODUKTU\nKG18R\n{HEATER}\nSpecyfikacja techniczna\nDo mocowania w rynnach "
        "stalowych oraz na dachach garaży.\nNapięcie zasilania 230V\n",
        HEATER,
        "Do mocowania w rynnach stalowych oraz na dachach garaży",
    ),
    "two-line description": (
        "Material type: Cement floor screed\nDane techniczne\nCS-40\nDo stosowania pod parkiet "
        "w suchych pokojach.\nPo ułożeniu folii i podczas montażu drzwi zimą.\n",
        "Cement floor screed",
        "Do stosowania pod parkiet w suchych pokojach Po ułożeniu folii i podczas montażu "
        "drzwi zimą",
    ),
    "sections": (
        "WEŁNOPAN 50 płyta dachowa Europejska Ocena Techniczna: ETA-11/0077\nOpis produktu "
        "Sprężyste płyty z wełny skalnej, odporne na mróz.\nZastosowanie Układa się je na "
        "stropach.\nDane techniczne Gęstość: 120 kg/m3\n",
        "WEŁNOPAN 50 płyta dachowa",
        "Sprężyste płyty z wełny skalnej, odporne na mróz",
    ),
    "declaration with a title": (
        "XPS 30 COKÓŁ-MUR\nDEKLARACJA WŁAŚCIWOŚCI UŻYTKOWYCH\nnr 7/XPS/2020\nTermodom\n\n"
        "Zamierzone zastosowanie lub zastosowania: Ocieplenie cokołów przy tarasach\n",
        "XPS 30 COKÓŁ-MUR",
        "Zamierzone zastosowanie lub zastosowania: Ocieplenie cokołów przy tarasach",
    ),
    "declaration with an identifier": (
        "Deklaracja Właściwości Użytkowych\nNr 5-GRN-Podkład 9\n\nNiepowtarzalny kod "
        "identyfikacyjny typu wyrobu: Granit Podkład 9\n\nZamierzone zastosowanie lub "
        "zastosowania: Gotowa masa do wyrównania podłoży\nProducent: Granit Dom\n"
        "Norma: PN 777:2019\n",
        "Granit Podkład 9",
        "Zamierzone zastosowanie lub zastosowania: Gotowa masa do wyrównania podłoży",
    ),
    "single line": (
        "GRESOWO Piasek Mat Płytka ścienna 300 x 600 mm Typ wyrobu: Płytki",
        "GRESOWO Piasek Mat Płytka ścienna 300 x 600 mm Typ wyrobu: Płytki",
        "GRESOWO Piasek Mat Płytka ścienna 300 x 600 mm Typ wyrobu: Płytki",
    ),
    "byte-order mark and dash": (
        "\ufeffMaterial type: Deska tarasowa\r\nDescription: Deska ryflowana â€” brązowa.\r\n",
        "Deska tarasowa",
        "Deska ryflowana — brązowa",
    ),
    "damaged encoding": (
        "Material type: DrÄ…Å¼ek stalowy do zasÅ‚on\n"
        "Description: Do zawieszenia na Å›cianach â€” kolor czarny.\n",
        "Drążek stalowy do zasłon",
        "Do zawieszenia na ścianach — kolor czarny",
    ),
    "first label decides": ("Opis: ---\nOpis: later\nMaterial: Szary beton\nX1", "Szary beton", "Szary beton"),
    "no viable line": ("Material: A\nX1\nY2", "A", "Material: A X1 Y2"),
}


@pytest.fixture(scope="module")
def extracted(spark):
    docs = spark.createDataFrame(
        [(name, text) for name, (text, _, _) in GOLDEN.items()], "source_path string, text string"
    )
    rows = extract_fields(docs, min_chars=5, diagnostics=True).collect()
    return {r.source_path: r for r in rows}


@pytest.mark.parametrize("name", [n for n in GOLDEN if n != "first label decides"])
def test_golden(extracted, name):
    _, material_type, description = GOLDEN[name]
    assert (extracted[name].material_type, extracted[name].description) == (
        material_type, description,
    )


def test_first_labelled_line_decides(extracted):
    row = extracted["first label decides"]
    assert row.material_type == "Szary beton"
    assert "later" not in row.description


def test_status_and_error(extracted):
    assert extracted["labels"].status == "ok" and extracted["labels"].error is None
    missing = extracted["missing"]
    assert missing.status == "parse_error"
    assert missing.error == "Missing required fields: material_type"
    assert missing.warnings == ["Missing required fields: material_type"]


def test_events(extracted):
    def steps(name):
        return [(e.field_name, e.step_name, e.status) for e in extracted[name].events]

    assert steps("labels") == [
        ("material_type", "labeled_extraction", "matched"),
        ("required_fields", "missing_required_fields", "ok"),
        ("description", "labeled_extraction", "matched"),
    ]
    assert steps("missing") == [
        ("material_type", "labeled_extraction", "not_matched"),
        ("material_type", "section_extraction", "not_matched"),
        ("material_type", "fallback_selection", "no_candidates"),
        ("required_fields", "missing_required_fields", "failed"),
    ]
    assert steps("ranked")[2:4] == [
        ("material_type", "fallback_candidates", "found"),
        ("material_type", "fallback_selection", "selected"),
    ]
    assert extracted["ranked"].events[2].note == "3 candidate(s)"


def test_gate(spark):
    docs = spark.createDataFrame(
        [("short.pdf", " short "), ("exact.pdf", "x" * 10), ("none.pdf", None)],
        "source_path string, text string",
    )
    rows = {r.source_path: r for r in extract_fields(docs, min_chars=10, diagnostics=True).collect()}
    assert rows["short.pdf"].status == "non_text"
    assert rows["short.pdf"].error == "PDF text too short: 5 chars (min 10)."
    assert rows["short.pdf"].events == [] and rows["short.pdf"].raw_text is None
    assert rows["exact.pdf"].status == "ok"
    assert rows["none.pdf"].status == "non_text"


def test_vocabulary_is_a_parameter(spark):
    vocab = Vocabulary(material_labels=("article",), description_labels=("text (long)",))
    docs = spark.createDataFrame(
        [("a", "Article - Blue chair\nText (long): Comfortable, with arms.")],
        "source_path string, text string",
    )
    row = extract_fields(docs, min_chars=0, vocab=vocab).head()
    assert (row.material_type, row.description) == ("Blue chair", "Comfortable, with arms")


def test_filter_does_not_repeat_the_cascade(spark):
    docs = spark.createDataFrame([("a", "b")], "source_path string, text string")
    extracted = extract_fields(docs)

    def uses(frame):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("niepowtarzalny kod identyfikacyjny")

    assert uses(extracted.where(F.col("status") == "ok")) == uses(extracted) > 0
