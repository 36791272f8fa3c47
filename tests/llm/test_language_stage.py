"""No clean document is rejected by the pipeline's language stage."""
import corpus_pipeline as P
from llm_rows import DOC, EN, FR

DE = "der hund und die katze sind mit den anderen tieren dieser stadt im haus "
ES = "el gato y el perro estan en la casa con los otros animales de esta ciudad "


def test_texts_in_several_languages_stay(spark):
    own = {"en": EN, "fr": FR, "de": DE, "es": ES}
    rows = [(i, t * 3, k, "s", 1) for i in range(20) for k, t in own.items()]
    mixed = [(100, (EN + FR + DE + ES) * 30, None, "s", 1), (101, (EN + DE + ES) * 30, "en", "s", 1)]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)] + mixed
    docs = spark.createDataFrame([*rows, (102, "12 !", "en", "s", 1)], DOC)
    got = P.identify_language(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted((r[0], r[1]) for r in rows)
    assert {r.lang for r in got} <= set(own)


def test_nothing_to_learn_from(spark):
    rows = [(1, "the cat", None, "s", 7), (2, "le chat", None, "s", 7), (3, None, None, None, 0)]
    got = P.identify_language(spark, spark.createDataFrame(rows, DOC), "").collect()
    assert sorted(tuple(r) for r in got) == rows
