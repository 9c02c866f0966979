import re
from collections import Counter

from ledgerloom.llm import line_cleaning as m

SPACE = "[\x20\x09-\x0d]"


def plain(text):
    text = text or ""
    words = re.findall(f"[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def figures(df):
    names = ["_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words"]
    return [(r["_row"]["text"], tuple(r[n] for n in names), r["_base_failed"], r["_kept"]) for r in m.judge(df).collect()]


def test_figures_against_brute_force(spark, odd, documents):
    texts = [(x,) for x in ("a b c a b c", "a a a a", "x\ny\nx\n \n \nx", "one two", "#|<> *\x0b\x0c\x1c w", "é é é é\né é é é")]
    df = spark.createDataFrame(texts, "text string")
    for part in (df, odd, documents.limit(60)):
        for text, got, failed, _ in figures(part):
            assert got == plain(text)
            assert failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])


def test_rules_and_cleaning(spark):
    body = "\n".join(" ".join(f"w{i}x{k}" for k in range(9)) + ", and so it ends." for i in range(8))
    junk = ["Home | News | Sport | About | Contact", "Please read our Privacy Policy first.", "WOW!! BUY!! NOW!! CHEAP!! THINGS!! ARE!! HERE!! TODAY!!", "words without any mark of a sentence in all of this line"]
    df = spark.createDataFrame([(1, body + "\n" + "\n".join(junk)), (2, "\n".join(junk * 1 + [j + " again" for j in junk] * 3) + body[:80])], "doc_id long, text string")
    got = m.clean(df).collect()
    assert [tuple(r) for r in got] == [(1, body)]


def test_query(spark, odd, none, saved):
    from ledgerloom.llm.catalogue import QUERIES

    got = QUERIES["op8_line_cleaning"](spark, saved(documents=odd)).collect()
    assert len(got) == 11
    assert {(r.n_words, r.base_failed, r.kept) for r in got if r.doc_id in (3, 4, 5)} == {(0, True, False)}
    assert QUERIES["op8_line_cleaning"](spark, saved(documents=none)).count() == 0
    assert m.clean(odd).columns == odd.columns
