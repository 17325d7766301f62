import hashlib
import math
import re

from pyspark.sql import functions as F

from loomcite.functions import text as t
from loomcite.functions.ids import concept_id, stable_id
from loomcite.functions.jsonfix import clean_json
from loomcite.functions.payload import canonical_key, label, quality, summary
from loomcite.functions.query import expansions, query_terms
from loomcite.operators.retrieval import with_lexical

L = F.lit


def test_stable_id_skips_empty_parts(one):
    expected = "W-" + hashlib.sha1(b"a\nb").hexdigest()[:12].upper()
    assert one(stable_id("W", L("a"), L(""), L(None), L("b"))) == expected == "W-FCD127FFA101"
    assert one(concept_id(L("baseline"), L("k"), L("s"))).startswith("BL-")
    assert one(concept_id(L("unheard_of"), L("k"), L("s"))).startswith("C-")


def test_tokenize_drops_stopwords_and_keeps_repeats(one):
    assert one(t.tokenize(L("The Prompt-tuning of prompt-tuning, 3d ab x1_y"))) == ["prompt-tuning", "prompt-tuning", "x1_y"]


def test_compact_text_cuts_and_squeezes(one):
    assert one(t.compact_text(L(" a b\n c "), 10)) == "a b c"
    assert one(t.compact_text(L("abcd efghij"), 8)) == "abcd..."


def test_sentences_and_canonical_text(one):
    assert one(t.sentences(L("One. Two!  Three? four.five"))) == ["One.", "Two!", "Three?", "four.five"]
    assert one(t.canonical_text(L("  A-Level: Été 2! "))) == "a level t 2"


def test_title_prefix_and_hyphens(one):
    assert one(t.clean_title_prefix(L("GPT-5.5: Falsifiable But Clean Title"))) == "Falsifiable But Clean Title"
    assert one(t.clean_title_prefix(L("OpenAI GPT5.5 - Cost-Aware CLIP Adapter"))) == "Cost-Aware CLIP Adapter"
    assert one(t.repair_hyphens(L("multi-step reason- ing ob- jective"))) == "multi-step reasoning objective"


def test_venues(one):
    assert one(t.peer_reviewed_venue(L("Accepted at ICML 2024 and KDD"), L(""))) == "ICML 2024"
    assert one(t.peer_reviewed_venue(L("12 pages"))) == ""
    ranks = [one(t.venue_rank(L(v))) for v in ("", "NeurIPS 2023", "arXiv", "Some Journal")]
    assert ranks == [0, 4, 1, 3]


def test_external_ids(one):
    assert one(t.clean_external_id(L(" https://doi.org/10.1/x "))) == "10.1/x"
    urls = F.array(L("https://arxiv.org/pdf/2305.12295v2"))
    assert one(t.arxiv_id(L(""), L("https://x.org"), urls)) == "2305.12295"
    assert one(t.arxiv_id(L(None), L(None), F.lit(None).cast("array<string>"))) == ""


def test_html_and_inverted_index(one):
    html = "<p>Hi <b>you</b></p><script>var a='<p>';</script><style>p{}</style> end"
    assert one(t.html_to_text(L(html))) == "Hi you end"
    index = F.from_json(L('{"b":[1,3],"a":[0],"c":[2]}'), "map<string,array<int>>")
    assert one(t.inverted_index_text(index)) == "a b c b"


def test_small_projections(one):
    assert one(t.slugify(L("Héllo, World! "))) == "h-llo-world"
    assert one(t.validation_number(L("level L4x2"))) == 4
    assert one(t.validation_number(L(None))) == 0
    assert one(t.estimate_tokens(L("abcdefgh"), L("ab"))) == 2
    assert one(t.price_per_million(L("DeepSeek-V4-pro"))) == 16.0
    assert one(t.price_per_million(L("deepseek-r1"))) == 10.0
    assert one(t.goal_kind(L("My idea draft: gates"))) == "idea_draft"
    assert one(t.split_list_text(L("First step. Second step\nfirst"))) == ["First step.", "Second step", "first"]
    assert one(t.ordered_union(F.array(L("a "), L("")), F.array(L("b"), L("a")))) == ["a", "b"]


def test_query_expansion(one):
    text = "稀疏数据 三维重建 forecasting of RUL"
    added = one(expansions(L(text)))
    assert added[0] == "3d reconstruction" and "sparse view" in added and "prognostics" in added
    assert one(expansions(L("a rule of thumb"))) == []
    assert set(query_terms("clip", 2)) >= {"clip", "vision-language", "transformer"}


def test_lexical_score(spark):
    df = spark.createDataFrame([(1, "gate gate prompt words"), (2, "nothing here"), (3, "")], "id int, body string")
    got = {r.id: r.lexical for r in with_lexical(df, "body", ["gate", "prompt"]).collect()}
    assert math.isclose(got[1], ((1 + math.log(3)) + (1 + math.log(2))) / math.sqrt(2 + 4))
    assert got[2] == got[3] == 0.0


def test_json_cleanup(spark):
    rows = [
        (1, '{"a": 1}'), (2, "{a: 1, b: [1,2,],}"), (3, 'Sure\n```json\n{"a": 1}\n```'), (4, 'so {"a": 1} it is'),
        (5, "so {a: “x”} it is"), (6, "none"), (7, '{"a": 1'), (8, '{"a": 1} and {"b": 2}'), (9, ""),
    ]
    out = {r.id: (r.repair_step, r.json) for r in clean_json(spark.createDataFrame(rows, "id int, s string"), "s").collect()}
    assert out[1] == ("parsed", '{"a": 1}')
    assert out[2] == ("repaired", '{"a": 1, "b": [1,2]}')
    assert out[3] == ("fenced", '{"a": 1}')
    assert out[4] == ("outermost", '{"a": 1}')
    assert out[5] == ("outermost_repaired", '{"a": "x"}')
    assert [out[i][0] for i in (6, 7, 8, 9)] == ["error"] * 4


def test_payload_summary_label_key_quality(one):
    payload = {"title": L(" T "), "mechanism": L("m"), "failure_modes": F.array(*[L(x) for x in "abcde"])}
    assert one(summary(payload)) == "T m a b c d"
    assert one(label(L("principle"), payload)) == "T"
    assert one(label(L("takeaway_message"), {"message_text": L("msg")})) == "msg"
    assert one(label(L("user_note"), {}, L(""))) == "User Note"
    assert one(canonical_key(L("T"), L("T m"), F.array(L("W-1"), L("W-2")))) == "t t m w 1 w 2"
    assert one(quality(L("x" * 450), L(1), [payload["failure_modes"]])) == 0.49


def test_strip_trims_the_whole_class_of_white_space_without_a_pattern(spark):
    codes = spark.range(1, 0xD800).select(F.char(F.lit(65)).alias("a"), F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    both = codes.select(
        t.strip(F.concat("c", "c", "a", "c", "a", "c")).alias("trimmed"), F.concat("a", "c", "a").alias("kept"), F.concat("c", "c", "a", "c", "a", "c").alias("all"),
        F.col("c").rlike(f"^{t.SPACE_CLASS}$").alias("space"))
    assert both.filter(F.col("trimmed") != F.when(F.col("space"), F.col("kept")).otherwise(F.col("all"))).count() == 0
    assert both.filter("space").count() == 25 + 4
    assert "regexp_replace" not in codes.select(t.strip("c"))._jdf.queryExecution().optimizedPlan().toString()


def test_an_inverted_index_is_made_in_its_row(spark):
    texts = ["b a  b\né a b", "", " \t", None, "one", " ".join(f"w{i * i % 97}" for i in range(500))]
    rows = t.inverted_index(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), "text")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    for r in rows.withColumn("back", t.inverted_index_text("index")).collect():
        words = re.sub(r"\s+", " ", texts[r.k] or "").strip(" ").split(" ")
        expected = {}
        for i, w in enumerate(words):
            expected.setdefault(w, []).append(i)
        assert r["index"] == expected and r.back == " ".join(words)
