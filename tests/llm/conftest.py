import zlib

import pytest

WORDS = "amber birch cedar delta ember frost grove heath inlet jetty knoll larch marsh north ocean pearl quartz ridge stone thorn umber vale wharf yarrow zephyr".split()
OTHER = "änder brücke chöre dünen eiche fähre gärten höhle insel jäger küste lärche mühle nebel örtchen pfähle".split()


def prose(seed: int, n: int, words=WORDS) -> str:
    """Made-up text that repeats no run of words."""
    out = []
    for i in range(n):
        seed = zlib.crc32(b"%d:%d" % (seed, i))
        out.append(words[seed % len(words)] + words[(seed >> 8) % len(words)][:3])
    return " ".join(out)


def corpus() -> list[tuple]:
    """doc_id, text, lang, source, n_chars, and clashing extra columns."""
    rows = []
    for i in range(120):
        text = prose(i, 60 + i % 30) if i % 3 else prose(i, 70, OTHER)
        rows.append((i, text, "en" if i % 3 else "de"))
    base = prose(5000, 120)
    rows += [(200, base, "en"), (201, base, "en"), (202, base + " tail", "en"), (203, base.upper(), None)]
    rows += [(204, prose(5000, 60) + " " + prose(77, 60), "en")]
    rows += [(300, None, "en"), (301, "", None), (302, "  \n\t ", "en"), (303, "12 34 !!", "en"), (304, "two words", "en"), (305, "two words", "en"), (306, "one two three", "en")]
    rows += [(400 + i, "stone " * (50 + i), "en") for i in range(20)] + [(430 + i, prose(i, 80).upper().replace(" ", "### "), "en") for i in range(20)]
    rows += [(500 + i, prose(900 + i, 60) + " scoundrelly vermin " + prose(950 + i, 20), "en") for i in range(30)]
    rows += [(600, prose(1, 20_000), "en"), (601, prose(1, 20_000), "en"), (302, "  \n\t ", "en"), (None, "no id at all", "en")]
    rows += [(602, "text with <|endoftext|> in it and é 中文 \x1c odd   spaces\r\n\n end ", "en")]
    return [(i, t, lang, "s", len(t or ""), "clash", -1.0, 7) for i, t, lang in rows]


def labels() -> list[tuple]:
    rows = [(i, 1, 0, 0) for i in range(120)] + [(400 + i, 0, 0, 0) for i in range(20)] + [(430 + i, 0, 0, 0) for i in range(20)] + [(500 + i, 1, 1, 0) for i in range(30)]
    return [*rows, (None, 1, 1, 0), (9999, 1, 0, 0), (7, None, None, 0), (8, 1, 0, 0)]


DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, sigs int"
LABELS = "doc_id long, quality int, toxic int, label int"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def label_rows(spark):
    return spark.createDataFrame(labels(), LABELS).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
