"""Empty tables, nulls in every column, and columns whose names clash: what each operator's docstring says of them."""

import public_tokenizers
import pytest

from plantstate.llm import fim, html, licenses, mixing, negatives, omh, pieces, pii, quality, repeats, secrets, topk, urls

#: Names that operators use for columns of their own; some differ from others by case only.
DOCS = "doc_id long, text string, lang string, source string, key string, `row` string, Text_ string, `a.b` int, n_words int, src string, h int"
PAGES = "page_id long, url string, html string, host string, Key string, path string, rule int, `t.x` int"
VECTORS = "vec_id long, embedding array<float>, label long, id int, `rank` int, uid int"
MODEL = public_tokenizers.path("piece_bpe_32k.model")

OPERATORS = {
    "op1": (DOCS, lambda d: mixing.mix(d)),
    "op1 rows": (DOCS, lambda d: mixing.mixed_documents(d)),
    "op2": (DOCS, lambda d: licenses.scanned(d)),
    "op3": (PAGES, lambda d: urls.judged(d, [("com/", "allow")])),
    "op4": (PAGES, lambda d: html.extracted(d)),
    "op5": (DOCS, lambda d: omh.classes(d)),
    "op5 rows": (DOCS, lambda d: omh.first_of_class(d)),
    "op6": (DOCS, lambda d: secrets.scanned(d)),
    "op7": (VECTORS, lambda d: topk.search_table(d)),
    "op8": (DOCS, lambda d: pii.replaced(d, key="k")),
    "op9": (DOCS, lambda d: pieces.encoded(d, MODEL)),
    "op10": (DOCS, lambda d: quality.judged(d)),
    "op11": (DOCS, lambda d: fim.transformed(d)),
    "op12": (DOCS, lambda d: repeats.without_repeats(d)),
    "op13": (VECTORS, lambda d: negatives.mined(d)),
}


def nulls(schema):
    return [tuple(None for _ in schema.split(", "))]


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_no_rows(spark, name):
    schema, run = OPERATORS[name]
    assert run(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("name", [n for n, (schema, _) in OPERATORS.items() if schema != VECTORS])
def test_rows_of_nulls_are_rows(spark, name):
    """Two rows of nulls are copies: one of them stays where copies go. The mix takes a source without words whole."""
    schema, run = OPERATORS[name]
    got = run(spark.createDataFrame(nulls(schema) * 2, schema)).count()
    assert got == {"op5 rows": 1}.get(name, 2)


@pytest.mark.parametrize("name", ["op7", "op13"])
def test_vectors_of_nulls_take_no_part(spark, name):
    schema, run = OPERATORS[name]
    bad = [(0, None, 1, 1, 1, 1), (100, [1.0, None], 1, 1, 1, 1), (200, [float("nan"), 1.0], 1, 1, 1, 1), (None, [1.0, 1.0], None, 1, 1, 1)]
    assert run(spark.createDataFrame(nulls(schema) + bad, schema)).collect() == []


def test_of_rules_of_one_length_the_first_by_code_point_wins(spark):
    page = spark.createDataFrame([(1, "http://a.b.com/xyz", None, None, None, None, None, None)], PAGES)
    for order in (1, -1):
        rules = [("b.com/xy", "block"), ("a.b.com/", "allow")][::order]
        got = urls.judged(page, rules).collect()
        assert [(r.rule, r.verdict) for r in got] == [("a.b.com/", "allow")]


def test_a_text_known_under_two_names_has_the_smaller(spark):
    known = spark.createDataFrame([("B", "Do as you like."), ("A", "do as  you like")], "name string, text string")
    docs = spark.createDataFrame([(1, "DO as you like!")], "doc_id long, text string")
    assert [r.license for r in licenses.scanned(docs, known).collect()] == ["A"]
