"""Variable-length gram index against brute force."""

import random
import re
import zlib

import pytest

from oracle import compare, connect
from pflegetakt.llm import spelling
from pflegetakt.llm.queries import ORACLE, QUERIES


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    same = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def some_words(seed, letters, n, least=6, most=9):
    rnd = random.Random(seed)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(least, most))) for _ in range(n)}
    for w in list(words):
        i = rnd.randrange(len(w))
        words |= {w[:i] + rnd.choice(letters) + w[i + 1 :], w[:i] + rnd.choice(letters) + w[i:]}
    return sorted(words)


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert compare(QUERIES["op11_spelling_variants"](spark, sf_dir), connect(sf_dir), ORACLE["op11_spelling_variants"]) == ""


@pytest.mark.parametrize("letters,frequent", [("ab", ["aa", "ab", "aba"]), ("abc", ["ab", "bc", "abc", "ca", "cab"]), ("aé", ["aé", "éa", "aéa", "\x02a", "\x02aé"]), ("abcdefgh", [])])
def test_one_edit_leaves_enough_grams(letters, frequent):
    """The bound holds for every near pair: enough grams stay, at the same place or one further."""
    inner = frozenset(g[k:] for g in frequent for k in range(1, len(g)))
    words = some_words(1, letters, 60)
    cut = {w: spelling.grams_of(w, frozenset(frequent), 4) for w in words}
    for a in words:
        for b in words:
            if one_apart(a, b) and len(a) <= len(b):
                moves = (0,) if len(a) == len(b) else (0, 1)
                shared = [(p, g) for p, g in cut[a] if any((p + m, g) in cut[b] for m in moves)]
                for w in (a, b):
                    least = len(cut[w]) - spelling.most_affected(w, cut[w], inner, 4)
                    assert 1 <= least <= len(shared)


@pytest.mark.parametrize("letters,most", [("ab", 4), ("abcé", 16), ("abcdefghij", 16_384)])
def test_near_words_equal_brute_force(spark, letters, most):
    words = some_words(2, letters, 120)
    rows = [(w, i + 1, "x", "y") for i, w in enumerate(words)]
    frame = spark.createDataFrame(rows, "word string, n long, id string, gram string")
    got = spelling.near_words(frame, 6, most=most).collect()
    wanted = {(a, b) for a in words for b in words if one_apart(a, b) and (len(a), a) < (len(b), b)}
    assert {(r["short_word"], r["long_word"]) for r in got} == wanted and len(got) == len(wanted)
    assert all(r["short_n"] == words.index(r["short_word"]) + 1 and r["long_n"] == words.index(r["long_word"]) + 1 for r in got)


def test_forms_are_followed_and_ties_take_the_least(spark):
    counts = {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "cccccc": 10, "ccccca": 50, "cccccb": 50, "zzzzzz": 3, "zzzzzy": 14}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: r for r in spelling.variant_groups(words, spelling.near_words(words, 6)).collect()}
    assert [got[w]["root"] for w in ("aaaaaa", "aaaaab", "aaaabb", "aaabbb")] == ["aaabbb"] * 4
    assert (got["cccccc"]["form"], got["cccccc"]["form_n"], got["cccccc"]["n_near"]) == ("ccccca", 50, 2)
    assert (got["zzzzzz"]["form"], got["zzzzzz"]["root"], got["zzzzzz"]["n_near"]) == (None, "zzzzzz", 1)


def test_reading_words(spark):
    rows = [(1, "Abcdef ÀBÇDEF x9abcdefg"), (None, "abcdef"), (2, None), (3, ""), (3, "abcdef " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    read = docs.selectExpr("doc_id", "text").select("doc_id", spelling.F.explode(spelling.words_of(docs["text"])).alias("run"))
    assert [r["run"] for r in read.where("doc_id = 1").collect()] == ["abcdef", "ÀbÇdef", "x", "abcdefg"]
    marked = read.select(spelling.without_marked_letter(read["run"], read["doc_id"], 2).alias("word"))

    def brute(doc_id, run):
        h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
        return run if h % 2 else run[: h % len(run)] + run[h % len(run) + 1 :]

    wanted = sorted(brute(d, w) for d, t in rows for w in re.findall("[a-zà-ÿÀ-ß]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    assert sorted(r["word"] for r in marked.collect()) == wanted
    assert spelling.count_words(marked, "word", 5, 3000).count() == 1


def test_short_words_are_refused_and_empty_tables_pass(spark):
    none = spark.createDataFrame([], "word string, n long")
    with pytest.raises(ValueError):
        spelling.near_words(none, 5)
    assert spelling.variant_groups(none, spelling.near_words(none, 6)).count() == 0
    lone = spark.createDataFrame([("a" * 50_000, 9), ("a" * 50_001, 5)], "word string, n long")
    assert spelling.near_words(lone, 6).count() == 1
