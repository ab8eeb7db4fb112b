"""Sections and fields of texts on hand-made texts."""

from tessera.operators import fields

TITLES = {"education": ["education"], "skills": ["skills", "what i know"]}


def test_sections_by_titles(spark):
    text = "Ann\nEducation: one school\nyear 2001\nSKILLS\nspark\neducation is a long sentence here\nWhat I know:\nsql\nEducation\nmore"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "no titles\nat all"), (4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.section): (r.lines, r.text) for r in fields.sections(docs, TITLES).collect()}
    assert got == {
        (1, "header"): (1, "Ann"), (1, "education"): (3, "one school\nyear 2001\nmore"), (1, "skills"): (3, "spark\neducation is a long sentence here\nsql"),
        (2, "header"): (1, ""), (3, "header"): (2, "no titles\nat all"),
    }


def test_fields_with_their_places(spark):
    docs = spark.createDataFrame([(1, "née a@b.org, 2001 and c@d.org"), (2, "nothing"), (3, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in fields.extracted(docs, {"email": r"[a-z]+@[a-z]+\.[a-z]+", "year": "[0-9]{4}", "none": "zzz"}).collect())
    assert got == [(1, "email", "a@b.org", 4, 11), (1, "year", "2001", 13, 17)]
