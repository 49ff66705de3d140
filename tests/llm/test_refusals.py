import random

from pyspark.sql import functions as F

from newsloom.llm import qa_defects


def test_alike_against_all_pairs(spark):
    """Every pair in a bucket is compared; with twelve bands hardly a similar pair shares none."""
    rng = random.Random(3)
    names = sorted({" ".join(sorted(rng.sample("a b c d e f g h i j k l".split(), 6))) for _ in range(300)})
    texts = spark.createDataFrame(list(enumerate(names)), "node long, text string")
    got = {(r["node"], r["other"]) for r in qa_defects.alike(texts, 0.7).collect()}
    near = {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if len(set(a.split()) & set(b.split())) >= 0.7 * len(set(a.split()) | set(b.split()))}
    assert got <= near and len(got) >= 0.98 * len(near) and all((j, i) in got for i, j in got)


def features(spark, rows):
    made = [
        (str(i), None, qa_defects.template(a), " ".join(qa_defects._first_words(a)).lower(), qa_defects.masked(qa_defects._WORDS.findall(q)), qa_defects.says_something(a, (q,)))
        for i, (q, a) in enumerate(rows)
    ]
    return spark.createDataFrame(made, "id string, kind string, template string, verbatim string, prompt string, own boolean")


ASKED = ("Who won the prize of the city?", "When does the factory close its doors?", "Which risks remain for Acme Corp?", "How far did profit fall?")


def test_refusals_without_a_list_of_phrases(spark):
    late = "Based on the information in the passage, I cannot say who it was."
    unlisted = "This passage offers nothing at all on the matter that was raised."
    german = "Dazu enthält der Text keine Angaben."
    rows = [(q, a) for a in (late, unlisted, german) for q in ASKED]
    rows += [(ASKED[2], "There is no word about Acme Corp to be found here."), (ASKED[0], "There is no word about it to be found here.")]
    facts = [(q, f"Revenue at Firm {n} rose by {k} percent in the last quarter.") for k, (q, n) in enumerate(zip(ASKED, ("Abel", "Baker", "Carl", "Dora")))]
    one_kind = [(f"Which risks remain for Firm {n}?", "It sees tariffs as the main risk.") for n in ("Abel", "Baker", "Carl")]
    quoted = [(q, f"This is no easy step for us, said {n} on Monday.") for q, n in zip(ASKED, ("Ann Abel", "Ben Baker", "Cid Carl", "dora doe"))]
    found = qa_defects.refusals(features(spark, rows + facts + one_kind + quoted + [("Why?", "Yes."), ("Who?", "Yes.")]))
    assert {r["template"] for r in found.collect()} == {qa_defects.template(a) for _, a in rows}
    assert qa_defects.refusals(features(spark, [("a", "b")]).where(F.lit(False))).count() == 0


def test_long_citations_are_cited():
    text = "Asked about it in a long and winding way by the reporters who came from all over the country to the hall, “" + "so " * 2000 + "”, the chair said: No."
    assert qa_defects._CITES.match(text) and not qa_defects._CITES.match("It rose. “No,” she wrote. He said: yes.")
