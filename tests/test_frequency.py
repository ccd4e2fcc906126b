"""Word frequencies and Treebank words against values written by hand and by the published rules."""

import gzip
import math
import struct

import pytest
from pyspark.sql import functions as F

from lexigauge.functions import text
from lexigauge.operators import frequency
from lexigauge.sources import binary


def pack(x) -> bytes:
    if isinstance(x, dict):
        return bytes([0x80 | len(x)]) + b"".join(pack(k) + pack(v) for k, v in x.items())
    if isinstance(x, list):
        head = bytes([0x90 | len(x)]) if len(x) < 16 else b"\xdc" + struct.pack(">H", len(x)) if len(x) < 1 << 16 else b"\xdd" + struct.pack(">I", len(x))
        return head + b"".join(map(pack, x))
    if isinstance(x, str):
        raw = x.encode()
        return (bytes([0xA0 | len(raw)]) if len(raw) < 32 else b"\xd9" + bytes([len(raw)]) if len(raw) < 256 else b"\xda" + struct.pack(">H", len(raw))) + raw
    return bytes([x])


LISTS = {"en": {"the": 129, "dog": 414, "run": 380, "0000": 300, "00": 280, "don't": 290, "x" * 40: 500, "y" * 300: 600}, "zh": {"谢谢": 360, "谢": 400, "你": 200}}


@pytest.fixture(scope="module")
def lists(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("lists")
    for name, words in LISTS.items():
        bins = [[w for w, k in words.items() if k == b] for b in range(601)]
        (folder / f"large_{name}.msgpack.gz").write_bytes(gzip.compress(pack([{"format": "cB", "version": 1}, *bins])))
    return binary.frequency_lists(spark, str(folder)).cache()


def test_lists(lists):
    got = {(r.list, r.word): r.frequency for r in lists.collect()}
    assert got == {(n, w): pytest.approx(10 ** (-k / 100)) for n, words in LISTS.items() for w, k in words.items()}


def test_other_files_are_an_error(spark, tmp_path):
    (tmp_path / "large_en.msgpack.gz").write_bytes(gzip.compress(pack([{"format": "other"}, ["a"]])))
    with pytest.raises(Exception, match="binned frequencies"):
        binary.frequency_lists(spark, str(tmp_path)).collect()


def three(f):
    return round(f, 2 - math.floor(math.log10(f)))


def zipf_of(f):
    return round(math.log10(three(f)) + 9, 2)


def test_zipf_by_hand(spark, lists):
    f = {w: 10 ** (-k / 100) for words in LISTS.values() for w, k in words.items()}
    year = 10 ** (-1.9185 - 0.0083 * (2019 - 1999)) + 0.1 * 0.300 / 1000
    want = {
        ("en", "the"): zipf_of(f["the"]), ("en", "The"): zipf_of(f["the"]), ("en", "don't"): zipf_of(f["don't"]), ("en", "dog,"): zipf_of(f["dog"]),
        ("en", "dog-run"): zipf_of(1 / (1 / f["dog"] + 1 / f["run"])), ("en", "dog-xyz"): 0.0, ("en", "..."): 0.0, ("en", ""): 0.0, ("en", "nothing"): 0.0,
        ("en", "1999"): zipf_of(f["0000"] * year), ("en", "2030"): zipf_of(f["0000"] * (10**-1.9185 + 0.1 * 0.175 / 1000)), ("en", "2050"): zipf_of(f["0000"] * (10 ** (-1.9185 - 0.2 * 11) + 0.1 * 0.175 / 1000)),
        ("en", "42"): zipf_of(f["00"] * 0.096 / 10), ("en", "the 42"): zipf_of(1 / (1 / f["the"] + 1 / (f["00"] * 0.096 / 10))), ("zh", "谢谢"): zipf_of(f["谢谢"]), ("zh", "谢-你"): zipf_of(1 / (1 / f["谢"] + 1 / f["你"]) / 10), ("zh", "the"): 0.0,
    }
    rows = spark.createDataFrame([*want, ("en", "the"), ("en", None), (None, "the")], "lang string, word string")
    got = frequency.zipf(rows, lists, language="lang").collect()
    assert len(got) == len(want) + 3
    assert {(r.lang, r.word): r.freq for r in got} == {**want, ("en", None): 0.0, (None, "the"): 0.0}
    one = frequency.zipf(rows.select("word"), lists.where("list = 'en'"), least=1.0)
    assert {r.word: r.freq for r in one.where("word in ('the', 'nothing')").collect()} == {"the": zipf_of(f["the"]), "nothing": 1.0}


def test_lists_too_large_to_broadcast(spark, lists, monkeypatch):
    from lexigauge.operators import ngrams

    rows = spark.createDataFrame([("en", "dog-run"), ("en", "1999")], "lang string, word string")
    both = sorted(map(tuple, frequency.zipf(rows, lists, language="lang").collect()))
    monkeypatch.setattr(ngrams, "SMALL", 0)
    assert sorted(map(tuple, frequency.zipf(rows, lists, language="lang").collect())) == both


def test_distinct_zipf_is_zipf(spark, lists):
    keys = spark.createDataFrame([("en", "the"), ("en", "The"), ("en", "dog-run"), ("en", "dog-xyz"), ("en", "1999"), ("en", "..."), ("en", None), (None, "the"), ("zh", "谢-你")], "lang string, word string")
    for counted in (False, True):
        got = frequency.distinct_zipf(keys, lists, "lang", 0.5, counted).select("word", "lang", "freq").collect()
        assert sorted(map(str, got)) == sorted(map(str, frequency.zipf(keys, lists, "lang", 0.5).select("word", "lang", "freq").collect()))


def test_words_are_counted_in_one_cut(spark):
    docs = spark.createDataFrame([("en", " a b\u00a0a "), ("en", "A"), (None, "a"), ("fr", ""), ("fr", None)], "lang string, text string")
    got = frequency.word_counts(docs, "lang")
    assert {(r.lang, r.word): r.n for r in got.collect()} == {("en", "a"): 2, ("en", "b"): 1, ("en", "A"): 1, (None, "a"): 1}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_word_table_cuts_texts_once(spark):
    from lexigauge.queries import QUERIES

    plan = QUERIES["zipf_word_table"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "[\\s" not in plan  # what follows reads the counts alone


def test_white_space_of_words(spark):
    # every character of the basic plane but halves of pairs, as the class of all white space has it
    rows = spark.createDataFrame([(c, f"a{chr(c)}b") for c in range(1, 1 << 16) if not 0xD800 <= c < 0xE000], "c int, t string")
    one, other = F.split("t", text.SPACES), F.split("t", f"{text.SPACE}+")
    assert rows.where(one != other).count() == 0 and rows.where(F.size(text.words(F.col("t"))) == 2).count() == 29


def test_empty(spark, lists):
    assert frequency.zipf(spark.createDataFrame([], "word string"), lists).count() == 0
    assert frequency.zipf(spark.createDataFrame([("a",)], "word string"), lists.where("false")).first().freq == 0


#: The published rules' examples, and others worked out by hand.
CUT = {
    "Good muffins cost $3.88\nin New York.  Please buy me two of them.\nThanks.": "Good|muffins|cost|$|3.88|in|New|York|.|Please|buy|me|two|of|them|.|Thanks|.",
    "They'll save and invest more.": "They|'ll|save|and|invest|more|.",
    "hi, my name can't hello,": "hi|,|my|name|ca|n't|hello|,",
    'She said "don\'t (ever) go." It\'s 3:30, isn\'t it?': "She|said|``|do|n't|(|ever|)|go|.|''|It|'s|3:30|,|is|n't|it|?",
    "I cannot... 'tis gonna be the dogs' house -- really!": "I|can|not|...|'t|is|gon|na|be|the|dogs|'|house|--|really|!",
    "\u201cQuoted\u201d \u00abtext\u00bb `code`": "\u201c|Quoted|\u201d|\u00ab|text|\u00bb|`|code|`",
    "$100,000.00 is 50%; A&B #1 @me *star* [x] {y} <z>": "$|100,000.00|is|50|%|;|A|&|B|#|1|@|me|*|star|*|[|x|]|{|y|}|<|z|>",
    "end.) ": "end|.|)",
    "d'ye gimme wanna go? more'n that": "d|'ye|gim|me|wan|na|go|?|more|'n|that",
    "gotta lemme wanna": "got|ta|lem|me|wan|na",
    "we've I'm he'd you're it'S WE'LL DON'T": "we|'ve|I|'m|he|'d|you|'re|it|'S|WE|'LL|DO|N'T",
    "a:b 1:2 x,": "a|:|b|1:2|x|,",
    "": "",
}


def test_treebank_words(spark):
    rows = spark.createDataFrame([(k,) for k in [*CUT, None]], "t string")
    got = {r.t: "|".join(r.w) for r in rows.select("t", text.treebank_words(F.col("t")).alias("w")).collect()}
    assert got == {**CUT, None: ""}
    whole = rows.where("t like 'Good%'").select(text.treebank_words(F.col("t"), by_sentence=False).alias("w")).first().w
    assert "York." in whole and whole[-2:] == ["Thanks", "."]


def test_vocabulary_of_treebank_words(spark):
    from lexigauge.operators import ngrams

    docs = spark.createDataFrame([(1, "The dog."), (2, "Don't run!"), (3, "the cat."), (4, None)], "doc_id int, text string")
    known = spark.createDataFrame([(w,) for w in ("the", "dog", ".", "do", "n't", "run", "!", None)], "word string")
    assert {r.doc_id for r in ngrams.vocabulary_filter(docs, "doc_id", ["text"], known, tokens=text.treebank_words).collect()} == {1, 2, 4}
    assert {r.doc_id for r in ngrams.vocabulary_filter(docs, "doc_id", ["text"], known).collect()} == {4}
