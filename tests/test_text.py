import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import intent, prompts
from plumbline.functions import text as tx
from plumbline.functions import vectors as vx
from plumbline.operators import chunking


def one(spark, value, expr, ddl="string"):
    return spark.createDataFrame([(value,)], f"c {ddl}").select(expr(F.col("c"))).first()[0]


WORDS = st.text(alphabet="ab3.!? \t\n \x1c é|-", max_size=60)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(WORDS, min_size=1, max_size=20))
def test_clean_tokens_sentences_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    rows = df.select("i", tx.clean_text(t), tx.strip(t), tx.tokenize(t), tx.split_sentences(tx.clean_text(t)),
                     tx.split_lines(t)).collect()
    for i, cleaned, stripped, tokens, sentences, lines in rows:
        text = texts[i]
        expected = re.sub(r"\s+", " ", text).strip()
        assert cleaned == expected
        assert stripped == text.strip()
        assert tokens == re.findall(r"[a-zA-Z0-9]+(?:\.[a-zA-Z0-9]+)*", text.lower())
        assert sentences == re.split(r"(?<=[.!?])\s+", expected)
        assert lines == [x.strip() for x in text.splitlines() if x.strip()]


def test_nfkd(spark):
    for text in ["plain ascii", "ﬁne  ½ é", "Å"]:
        expected = re.sub(r"\s+", " ", unicodedata.normalize("NFKD", text)).strip()
        assert one(spark, text, tx.normalize_nfkd) == expected


def test_file_kind_titles_uris(spark):
    kinds = {"a.PDF": "PDF", "b.csv": "CSV", "c.jpeg": "IMG", "notes": "TXT", "": "?"}
    assert {k: one(spark, k, tx.file_kind) for k in kinds} == kinds
    assert one(spark, "x" * 31, tx.session_title) == "x" * 30 + "..."
    assert one(spark, "x" * 30, tx.session_title) == "x" * 30
    assert bytes(one(spark, "data:image/png;base64,aGk=", tx.decode_data_uri)) == b"hi"
    assert one(spark, "data:broken", tx.decode_data_uri) is None


def test_intent_and_weights(spark):
    cases = {"What is X": "lookup", "a VS b": "comparison", "How to do": "procedural", "Explain it": "analytical",
             "whyever": "analytical", "tell me": "general", "what is better, and why": "lookup"}
    assert {q: one(spark, q, intent.classify_intent) for q in cases} == cases
    weights = {"plain": 1.0, "sum": 1.12, "list the 3 best, total average vs mean": 1.5}
    for q, w in weights.items():
        assert abs(one(spark, q, intent.table_query_weight) - w) < 1e-9
    assert one(spark, "what is 1", lambda q: intent.needs_expansion(q)) is False
    assert one(spark, "explain", lambda q: intent.needs_expansion(q, False)) is False
    assert one(spark, "q", lambda q: intent.apply_expansion(q, F.lit("[key NOT SET]"))) == "q"
    assert one(spark, "q", lambda q: intent.apply_expansion(q, F.lit("[1] fine"))) == "q [1] fine"
    assert one(spark, "sum", lambda q: intent.adaptive_k(F.lit("table"), q, {"table": 30})) == 33


def guard(spark, reply, answer="a", contents=("s",)):
    df = spark.createDataFrame([(reply, answer, list(contents))], "r string, a string, c array<string>")
    g = df.select(prompts.parse_guard(F.col("r"), F.col("a"), F.col("c")).alias("g")).first().g
    return g.verified, g.score, [(c.claim, c.supported) for c in g.claims]


def test_parse_guard(spark):
    assert guard(spark, "nonsense") == (True, 0.5, [])
    assert guard(spark, "[1]") == (True, 0.5, [])
    assert guard(spark, "{}", answer="") == (True, 1.0, [])
    assert guard(spark, "{}", contents=()) == (True, 1.0, [])
    assert guard(spark, "{}") == (True, 0.5, [])
    assert guard(spark, '{"verified": false, "score": "0.75"}') == (False, 0.75, [])
    assert guard(spark, '{"verified": false, "score": "high"}') == (True, 0.5, [])
    fenced = '```json\n{"score": 1, "claims": [{"claim": "x", "supported": false}]}\n```'
    assert guard(spark, fenced) == (True, 1.0, [("x", False)])


def test_source_references_are_replaced_once(spark):
    df = spark.createDataFrame([("![a](source_1) /api/uploads/SOURCE_2 source_12 source_0\\n```\n![b](source_1)\n```",
                                 [{"source": "source_2.png"}, {"source": "two.png"}, {}])],
                               "t string, m array<map<string,string>>")
    sources = F.transform("m", lambda m: F.struct(m.alias("metadata")))
    out = df.select(prompts.resolve_source_refs(F.col("t"), sources)).first()[0]
    assert out == ("![a](/api/uploads/source_2.png) /api/uploads/two.png source_12 source_0\n"
                   "![b](/api/uploads/source_2.png)")


def test_prompt_layout(spark):
    df = spark.createDataFrame([("q", [("text", "A" * 1600, {}), ("image", "B", {"source": "p.png"})])],
                               "q string, s array<struct<modality string, content string, metadata map<string,string>>>")
    out = df.select(prompts.build_prompt(F.col("q"), F.col("s"), "SYS", "REM")).first()[0]
    assert out == ("SYS\n\n--- Sources ---\n\n[Source 1 (text)]:\n" + "A" * 1500
                   + "\n\n[Source 2 (image, Image URL: /api/uploads/p.png)]:\nB\n\n\n--- Question ---\nq\n\nREM")


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], vx.l2_normalize, "array<float>") == [0.6000000238418579, 0.800000011920929]
    assert one(spark, [0.0, 0.0], vx.l2_normalize, "array<float>") == [0.0, 0.0]
    assert one(spark, [1.0], lambda c: vx.fit_dims(c, 3), "array<float>") == [1.0, 0.0, 0.0]
    assert one(spark, [1.0, 2.0], lambda c: vx.fit_dims(c, 1), "array<float>") == [1.0]
    assert one(spark, [1.5, -2.0], vx.vector_to_text, "array<float>") == "[1.5,-2.0]"
    assert one(spark, "[0.5,1]", vx.vector_from_text) == [0.5, 1.0]


def pieces_by_hand(text, limit, overlap):
    text = re.sub(r"\s+", " ", text).strip()
    if not text:
        return []
    done, current = [], ""
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        if len(current) + len(sentence) < limit:
            current = f"{current} {sentence}"
            continue
        done.append(current.strip())
        current = f"{current[-overlap:]} {sentence}"
    return [c for c in done + [current.strip()] if c]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab. !?é", max_size=120), min_size=1, max_size=10))
def test_text_pieces_follow_the_packing_rule(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for i, got in df.select("i", chunking.text_pieces(F.col("t"), 30, 8)).collect():
        assert got == pieces_by_hand(texts[i], 30, 8)


def test_overlap_and_long_sentence(spark):
    long = "x" * 2000 + "."
    got = one(spark, f"Short one. {long} End.", chunking.text_pieces)
    assert got[0] == "Short one." and got[1] == f"Short one. {long}" and len(got[1]) > 1800
    assert got[2].endswith(" End.") and len(got[2]) <= 200 + 5
