import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontamination as dc
from plumbline.llm import packing, pseudonyms
from plumbline.llm.queries import tokenizer_path

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM_ROWS = [(1, " ".join(f"w{i}" for i in range(20))), (10, "Tiny item"), (2, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17"), (3, ""), (4, None),
             (5, "tiny ITEM"), (None, "nameless benchmark words"), (6, "über-alles x" + " y" * 30), (7, "solo")]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def contaminated_by_hand(text):
    words, hit, items = WORDS.findall(lower(text)), set(), set()
    for item, item_text in ITEM_ROWS:
        own = WORDS.findall(lower(item_text))
        n = min(13, len(own))
        for s in range(len(own) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at:at + n] == own[s:s + n]:
                    hit.update(range(at, at + n))
                    items.add("" if item is None else str(item))
    ids = ",".join(sorted(items))
    return (len(words), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words))


def doc_rows():
    long_text = "filler " * 30000 + "W0,w1;w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 tiny\nitem"
    return [(1, "a b " + ITEM_ROWS[0][1] + " c"), (2, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (3, "some tiny item here solo"), (4, None), (5, ""),
            (6, "!!! ..."), (7, "ÜBER alles x y y y y y y y y y y y"), (8, "über-alles x" + " y" * 14), (9, long_text), (3, "some tiny item here solo"),
            (None, "nameless benchmark words"), (10, "tiny tiny item item"), (11, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 " * 3)]


@pytest.mark.parametrize("group_bytes", [1 << 24, 100])  # 100: several groups, merged
def test_decontamination(table, group_bytes):
    found = dc.find_benchmark(table(doc_rows(), DOCS), table(ITEM_ROWS + ITEM_ROWS[:2], ITEMS), group_bytes=group_bytes)
    out = dc.summary(found)
    assert sorted((str(r[0]), *r[1:]) for r in out.collect()) == sorted((str(i), *contaminated_by_hand(t)) for i, t in doc_rows())


def test_decontamination_of_empty_tables(table):
    assert dc.summary(dc.find_benchmark(table([], DOCS), table(ITEM_ROWS, ITEMS))).count() == 0
    assert dc.summary(dc.find_benchmark(table(doc_rows(), DOCS), table([], ITEMS))).where("n_hit > 0 or contaminated").count() == 0


def pack_rows():
    return [(i, f"Document {i}, about topic{i % 5} " + f"word{i % 7} né*** İX don't ٣ " * (i % 40)) for i in range(120)] + [
        (500, None), (501, ""), (502, "x " * 9000), (503, "<|endoftext|> and <|startoftext|>text"), (506, "twice"), (506, "twice"), (None, "no id"),
        (504, "A!! B** " * 300), (505, "\u2003wide\u3000space\x1cx")] + [(1000 + i, "the very same copy") for i in range(300)]


def test_packing_holds_every_id_once(table):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rows = pack_rows()
    out = [r.asDict() for r in packing.pack(table(rows, DOCS), tokenizer_path(), with_ids=True).collect()]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) > 0
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        own = pieces[i]
        copies = sum(1 for j, _ in rows if j == i)
        assert sum(r["length"] for r in own) == len(ids) * copies and {r["doc_tokens"] for r in own} == {len(ids)}
        for r in own:
            assert r["ids"] == ids[r["start"]:r["start"] + r["length"]]
    for s, own in sequences.items():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert sum(r["length"] for r in own) == 2048 or s == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(table([], DOCS), tokenizer_path()).count() == 0


def test_ids_of_any_unicode_text_whatever_is_held():
    from tokenizers import Tokenizer

    tok, random = Tokenizer.from_file(tokenizer_path()), np.random.default_rng(5)
    marks = [chr(c) for c in (0x300, 0x308, 0x30C, 0x331, 0x338, 0x345, 0x1DC4, 0x20D7)]
    pool = [*"abJTHIjtk AZ.!?'\"<>|=09 \n\t", *marks, *"éÉßſİıǰ中語한글अの𝔄𐐀", "\u00a0", "\u2003", "\x1c", "\ufb01", "'s ", "<|endoftext|>", "abc ", "Word. "]
    texts = ["".join(random.choice(pool, random.integers(0, 40))) for _ in range(3000)] + ["J\u030c T\u0308 H\u0331 J\u0323\u030c", "=\u0338 abc=\u0338"]
    for held in (1 << 30, 1 << 15):
        coder = packing.Encoder(tokenizer_path(), held)
        got = [i.tolist() for k in range(0, len(texts), 50) for i in coder.encode([t.encode() for t in texts[k:k + 50]])]
        assert got == [[*tok.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert coder.size < held + 50 * 300 * 40  # never more than the bound and what one call adds


def test_words_and_their_tails_are_told_apart():
    from tokenizers import Tokenizer

    tok, random = Tokenizer.from_file(tokenizer_path()), np.random.default_rng(6)
    assert packing._chunked("Été, deux. Trois.\nl'été.".encode()) == "ÉtÉ , deux . trois . l'été.".replace("tÉ", "té").encode().split()
    ends = [". ", ", ", ".\n", " ", "! ", "' ", "'s. ", "×, ", "÷. ", "”. ", ".. ", "\x1c. ", "3. ", ".", ","]
    texts = ["".join(f"{random.choice(['été', 'Ñandú', 'über', 'plain', 'Àé', '5', ''])}{random.choice(ends[:n])}" for _ in range(12)) for n in (3, 5, 8, 15) for _ in range(300)]
    coder = packing.Encoder(tokenizer_path())
    assert [i.tolist() for i in coder.encode([t.encode() for t in texts])] == [[*tok.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_packing_with_little_room_is_the_same(table):
    rows = pack_rows()
    packed = lambda **more: sorted((tuple(r) for r in packing.pack(table(rows, DOCS), tokenizer_path(), **more).collect()), key=str)
    assert packed(held_bytes=1 << 12) == packed()


def test_hilbert_neighbours_touch():
    grid = np.array([[i, j, k] for i in range(8) for j in range(8) for k in range(8)])
    keys = packing.hilbert_keys(grid + 0.0 - 4, bits=3)
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)
    assert len(set(keys)) == 512 and set(steps) == {1}


CASES = {
    "card 4845168114407329, 4845-1681-1440-7329 and bad 2353820953013749": ["card", "card"],
    "two 7536784127813056 4845168114407329": None, "mail r.23@mail3.example.com, X@a.co.": ["email", "email"], "999.1.1.1 97.51.17.173": ["ip"],
    "+1 (706) 555-3138 96.153.118.61 +44 20 7946 0958": ["phone", "ip", "phone"], "123-45-6789 000-12-3456 666-12-3456": ["ssn"],
    "2020-02-29 29.02.2021 31/12/1999 1999/12/31 31.12.1999": ["date"] * 4, "GB82 WEST 1234 5698 7654 32 GB82WEST12345698765431": ["iban"],
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x': ["secret"], "nothing 12 here 2024": [], "": []}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms(table):
    texts = list(CASES)
    rows = [(i, t) for i, t in enumerate(texts)] + [(90, None), (91, texts[0] + " again"), (91, texts[0] + " again"), (92, "a" * 200000 + " 97.51.17.173")]
    out = pseudonyms.pseudonymise(table(rows, DOCS).withColumn("pseudonyms", F.lit("clash")), "key")
    by_id = defaultdict(list)
    for r in out.collect():
        by_id[r["doc_id"]].append(r)
    for i, t in enumerate(texts):
        found = by_id[i][0]["pseudonyms"]
        if CASES[t] is not None:
            assert [p["kind"] for p in found] == CASES[t], t
        for p in found:
            assert p["value"] not in t and p["value"] in by_id[i][0]["text"]
            if p["kind"] == "card":
                assert luhn(re.sub(r"\D", "", p["value"]))
            if p["kind"] == "iban":
                v = p["value"].replace(" ", "")
                assert int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
            if p["kind"] == "ip":
                assert all(0 <= int(o) < 256 for o in p["value"].split("."))
        if not found:
            assert by_id[i][0]["text"] == t
    assert "2353820953013749" in by_id[0][0]["text"] and by_id[90][0]["text"] is None
    first, again = by_id[0][0]["pseudonyms"], by_id[91][0]["pseudonyms"]
    assert first == again and len(by_id[91]) == 2  # equal values stay linked
    assert re.sub(r"\D", "", first[0]["value"]) == re.sub(r"\D", "", first[1]["value"])  # in any notation
    ip = [p["value"] for p in by_id[texts.index("999.1.1.1 97.51.17.173")][0]["pseudonyms"]]
    assert by_id[92][0]["text"].endswith(" " + ip[0])
    dates = [p["value"] for p in by_id[6][0]["pseudonyms"]]
    assert dates[1][6:] + dates[1][3:5] + dates[1][:2] == dates[2].replace("/", "") == "".join(reversed(dates[3].split(".")))
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    assert pseudonyms.pseudonymise(table([], DOCS), "key").count() == 0


FORMS = {
    "at 2021-03-04T10:00:00Z": "date", "12/31/2020": "date", "5-13-1999 x": "date", "+33 1 23 45 67 89": "phone", "+33.1.23.45.67.89": "phone",
    "+61 2 9374 4000": "phone", "+41 44 668 18 00": "phone", "+47 22-12-34-56": None, "555 123 4567": "phone", "13/32/2020": None, "2021-03-04Tea": None}


def test_forms_of_dates_and_phones(table):
    alone = "2021-03-04 31/12/2020 +33 1 23 45 67 89 97.51.17.173 4845 1681 1440 7329 12 555-123-4567"
    out = {r["doc_id"]: r for r in pseudonyms.pseudonymise(table([*enumerate([*FORMS, alone])], DOCS), "key").collect()}
    for i, (t, kind) in enumerate(FORMS.items()):
        assert [p["kind"] for p in out[i]["pseudonyms"]] == ([kind] if kind else []), t
        assert (out[i]["text"] == t) == (kind is None)
    values = {p["kind"]: p["value"] for p in reversed(out[len(FORMS)]["pseudonyms"])}
    assert [p["kind"] for p in out[len(FORMS)]["pseudonyms"]] == ["date", "date", "phone", "ip", "card", "phone"]
    assert out[0]["text"] == f"at {values['date']}T10:00:00Z" and out[3]["text"] == values["phone"]  # equal values stay linked
    day, month, year = out[len(FORMS)]["pseudonyms"][1]["value"].split("/")
    assert out[1]["text"] == f"{month}/{day}/{year}"


def test_forms_of_secrets(table):
    jwt = "eyJhbGciOi." + "aB3_-x." * 56
    forms = [f'token = "{jwt}"', f"{{'token': '{jwt}'}}", f'{{"api_key": "{jwt}", "n": 1}}', "password='it''s'", 'secret: "p@ss=\'w0rd1"', "token='short'",
             'PASSWORD="' + "Ab1" * 20000 + '" end', "it's token 'of a kind'"]
    out = {r["doc_id"]: r for r in pseudonyms.pseudonymise(table([*enumerate(forms)], DOCS), "key").collect()}
    assert [[p["kind"] for p in out[i]["pseudonyms"]] for i in range(8)] == [["secret"]] * 3 + [[]] + [["secret"], [], ["secret"], []]
    new = out[0]["text"][9:-1]
    assert len(new) == len(jwt) > 400 and new != jwt and [out[i]["text"] for i in range(3)] == [f.replace(jwt, new) for f in forms[:3]]
    assert re.fullmatch(r"secret: \"[a-z]@[a-z]{2}='[a-z]\d[a-z]{2}\d\"", out[4]["text"]) and out[4]["text"] != forms[4]
    assert re.fullmatch(r'PASSWORD="(?:[A-Z][a-z]\d){20000}" end', out[6]["text"]) and forms[6] != out[6]["text"]


def test_pair_network_is_a_permutation(spark):
    rows = spark.range(7 * 11).select((F.col("id") / 11).cast("int").alias("l"), (F.col("id") % 11).alias("r"))
    out = rows.select(pseudonyms.permute_pair(F.col("l"), F.col("r"), 7, 11, "k", "t").alias("p")).select("p.*").distinct()
    assert out.count() == 77 and out.where("l between 0 and 6 and r between 0 and 10").count() == 77
    digits = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert digits.select(pseudonyms.permute_text(F.col("d"), "k", "t").alias("x")).where("x rlike '^[0-9]{3}$'").distinct().count() == 1000


def test_a_phone_in_any_grouping_is_one_pseudonym(table):
    forms = ["+442079460958", "+44 20 7946 0958", "+44-20-7946-0958", "+1 (706) 555-3138", "+17065553138", "+35312345678", "+353 1 234 5678"]
    out = pseudonyms.pseudonymise(table([(i, f"call {v} now") for i, v in enumerate(forms)], "doc_id long, text string"), "k")
    new = ["".join(c for c in r.text if c.isdigit()) for r in out.orderBy("doc_id").collect()]
    assert new[0] == new[1] == new[2] and new[3] == new[4] and new[5] == new[6]
    old = ["".join(c for c in v if c.isdigit()) for v in forms]
    assert all(a != b and len(a) == len(b) for a, b in zip(old, new))
    assert new[0][:2] == "44" and new[3][0] == "1" and new[5][:3] == "353"


def test_texts_are_permuted_within_their_shape(spark):
    """All values of a small set come back once each; hex stays hex and digits stay digits."""
    pairs = spark.range(0, 10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("v"))
    assert pairs.select(pseudonyms.permute_text(F.col("v"), "k", "t").alias("p")).distinct().count() == 10_000
    letters = spark.range(0, 676 * 10).select(F.concat(F.chr(97 + F.col("id") % 26), F.chr(97 + F.floor(F.col("id") / 26) % 26),
                                                       F.floor(F.col("id") / 676).cast("string")).alias("v"))
    out = letters.select(pseudonyms.permute_text(F.col("v"), "k", "t").alias("p")).distinct()
    assert out.count() == 6760 and out.where("p rlike '^[a-z]{2}[0-9]$'").count() == 6760
    mixed = spark.range(0, 3000).select(F.explode(F.array(
        F.substring(F.md5(F.col("id").cast("string")), 1, 16), F.concat(F.lit("abcdef0123456a"), F.lpad(F.col("id").cast("string"), 4, "z")),
        F.lpad(F.col("id").cast("string"), 16, "1"))).alias("v")).distinct()
    shaped = mixed.select("v", pseudonyms.permute_text(F.col("v"), "k", "t").alias("p")).cache()
    assert shaped.select("p").distinct().count() == mixed.count()
    assert shaped.where(F.col("v").rlike(pseudonyms.HEX_SHAPE) != F.col("p").rlike(pseudonyms.HEX_SHAPE)).count() == 0


def test_any_column_name_is_kept(spark):
    rows = spark.createDataFrame([(1, "mail a.b@example.org", "mine"), (2, None, None)], "doc_id long, text string, _new string")
    out = pseudonyms.pseudonymise(rows, "k").orderBy("doc_id").collect()
    assert [r["_new"] for r in out] == ["mine", None] and out[0].text != "mail a.b@example.org" and out[1].text is None
