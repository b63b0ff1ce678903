"""Corpus operators as DataFrames: against brute force on a small table, and on awkward input."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chronolens.llm import chat, decontaminate, html_extract, licenses, line_dedup, lm_score, ngram_join, packing, quality, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig long, n long"
LONG = "\n".join(f"line {i} of a very long text {i * i % 997}" for i in range(30_000))
AWKWARD = [
    (1, None, "en", None, None, 1, 1),
    (2, "", None, "s", 0, 1, 1),
    (3, " \t\n", "xx", "s", 3, 1, 1),
    (4, "one two", "en", "s", 7, 1, 1),
    (5, "ONE two", "en", "s", 7, 1, 1),
    (5, "ONE two", "en", "s", 7, 1, 1),
    (None, "alpha beta gamma delta epsilon zeta", "en", "s", 1, 1, 1),
    (7, "a b\nc d\ne f\ng h", "en", "s", 1, 1, 1),
    (8, "x y\nc d\ne f\ng h\nz", "en", "s", 1, 1, 1),
    (9, LONG, "en", "s", len(LONG), 1, 1),
    (10, LONG + "\nand more", "en", "s", 1, 1, 1),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "", r["lang"]) for r in docs.collect()]


def words(text):
    return text.encode().lower().split()


def brute_components(rows):
    """Smallest linked id, by comparing all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in held[x])
        for j, c in shared.items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c) and find(i) != find(j):
                root[find(i)] = find(j)
        for x in s:
            held[x].append(i)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min([x for x in (least.get(find(i)), rows[i][0]) if x is not None], default=None)
    return [(rows[i][0], len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))]


def test_near_duplicates(docs, rows):
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(docs).collect())
    assert got == sorted(brute_components([(i, t) for i, t, _ in rows]))
    assert len({c for _, _, c in got}) < len(got)


def test_near_duplicates_in_chains_and_hot_groups(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(60)] * 3  # one word changed in each
    texts += [" ".join(f"c{j}" for j in range(k, k + 80)) for k in range(0, 120, 6)]  # a chain of shifted texts
    texts += ["same passage of ten words that everybody has at last " + " ".join(f"u{k}q{j}" for j in range(30)) for k in range(80)]
    table = [(i, t) for i, t in enumerate(texts)]
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect())
    assert got == sorted(brute_components(table))


def test_near_duplicates_in_groups_cut_into_blocks(spark, monkeypatch):
    """Groups that share hot passages without being linked, with links and chains among them, in many small blocks."""
    for name, value in (("SHARED_SETS", 8), ("SHARED_BLOCKS", 6), ("BLOCK_SETS", 20), ("HOT_TOTAL", 1 << 40)):
        monkeypatch.setattr(ngram_join, name, value)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [passage + " " + " ".join(f"u{k // 3}q{j}" for j in range(26 + k % 3)) for k in range(150)]  # threes that link, all with one passage
    texts += [passage + " " + " ".join(f"c{j}" for j in range(k, k + 60)) for k in range(0, 90, 6)]  # a chain with it
    table = [(i, t) for i, t in enumerate(texts)]
    got = sorted(tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect())
    assert got == sorted(brute_components(table))


def test_near_duplicates_awkward(awkward, empty):
    got = sorted((tuple(r) for r in ngram_join.near_duplicates(awkward).collect()), key=str)
    want = brute_components([(r[0], r[1] or "") for r in AWKWARD])
    assert got == sorted(want, key=str)
    assert ngram_join.near_duplicates(empty).count() == 0
    kept = ngram_join.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "7", "8", "9", "None"])


def brute_lines(rows):
    """rows: (id, text). Places of a window come in the order of id and line; the first stays."""
    windows = defaultdict(list)
    full = []
    for row, (_, text) in enumerate(rows):
        lines = [(i, x.strip(" \t\n\r\x0b\x0c")) for i, x in enumerate(text.split("\n"))]
        full.append([x for x in lines if x[1]])
        for k in range(len(full[-1]) - 2):
            windows[tuple(x[1] for x in full[-1][k : k + 3])].append((rows[row][0], k, row))
    gone = [set() for _ in rows]
    for places in windows.values():
        for _, k, row in sorted(places)[1:]:
            gone[row].update(full[row][j][0] for j in range(k, k + 3))
    return [(i, len(f), len(g), "\n".join(x for j, x in enumerate(t.split("\n")) if j not in g)) for (i, t), f, g in zip(rows, full, gone, strict=True)]


def test_line_dedup(docs, rows):
    got = sorted((r["doc_id"], r["__n_lines"], r["__n_removed"], r["text"]) for r in line_dedup.dedup_lines(docs).collect())
    want = sorted(brute_lines([(i, t) for i, t, _ in rows]))
    assert got == want and sum(x[2] for x in want) > 0


def test_line_dedup_awkward(awkward, empty):
    got = {(r["doc_id"], r["__n_removed"]): r for r in line_dedup.dedup_lines(awkward).collect()}
    assert got[8, 3]["text"] == "x y\nz" and got[7, 0]["text"] == AWKWARD[7][1] and got[1, 0]["text"] is None
    assert got[10, 30_000]["text"] == "and more" and got[9, 0]["text"] == LONG
    out = line_dedup.dedup_lines(empty)
    assert out.count() == 0 and out.columns == [*empty.columns, "__n_lines", "__n_removed"]


def test_packing(docs, rows):
    out = packing.pack(docs, max_len=100, n_buckets=5, budget=500).collect()
    got = defaultdict(list)
    for r in out:
        got[r["doc_id"]].append((r["piece"], r["n_tokens"]))
    for i, text, _ in rows:
        n = len(words(text))
        assert sorted(got.get(i, [])) == [(k, min(100, n - 100 * k)) for k in range(-(-n // 100))]
    bounds = packing.boundaries(sorted({r["n_tokens"] for r in out}), [c for _, c in sorted(Counter(r["n_tokens"] for r in out).items())], 5)
    batches = defaultdict(list)
    for r in out:
        assert r["bucket_len"] == min(b for b in bounds if b >= r["n_tokens"])
        batches[r["bucket_len"], r["batch"]].append(r["slot"])
    for (size, batch), slots in batches.items():
        per = max(1, 500 // size)
        assert sorted(slots) == list(range(len(slots))) and (len(slots) == per or batch == max(b for s, b in batches if s == size))


def test_word_count(spark):
    texts = [None, "", " ", "\n\t\x0b\x0c\r ", "a", " a", "a ", "\ta\nb\r\n", "é ü x  y\x0b", "x" * 100_000 + " y " + " " * 100_000 + "z ", "\x00 \x1f \x85 q", "a\x1cb \x1d"]
    out = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", packing.word_count(F.col("t")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in out} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}


def test_packing_awkward(awkward, empty):
    out = packing.pack(awkward)
    assert {r["doc_id"] for r in out.collect()} == {4, 5, None, 7, 8, 9, 10} and out.where("doc_id = 5").count() == 2
    assert packing.pack(empty).count() == 0


def test_quality(awkward, empty, docs):
    got = {r["doc_id"]: r for r in quality.judge(awkward).collect()}
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (1, 2, 3, 4, 5, 7, 8)) and got[9]["n_words"] == 240_000
    assert quality.judge(awkward).count() == len(AWKWARD) and quality.judge(empty).count() == 0
    judged = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, k in judged.items() if k}
    assert 0.5 < sum(judged.values()) / len(judged) < 1


def brute_quality(rows):
    """Whether each (text, lang) is kept, with words, windows, classes and distances in plain Python."""
    import unicodedata

    spaces = " \t\n\x0b\x0c\r"

    def kind(c):
        if c in "#*$%&|<>":
            return 3
        if c.isascii():
            return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4
        return {"L": 5, "M": 5, "N": 2}.get(unicodedata.category(c)[0], 4)

    def split(text):
        return [w for w in re.split("[ \\t-\\r]+", text) if w]

    def histogram(words, lang):
        common = quality.COMMON_WORDS[lang].split()
        out = [0] * (len(common) + 1)
        for w in words:
            slot = next((i for i, x in reversed(list(enumerate(common))) if w in (x, x.title(), x.upper())), len(common))
            out[slot] += 1
        return out

    def distance(p, q):
        p, q = [x / max(sum(p), 1) for x in p], [x / sum(q) for x in q]
        part = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b, strict=True) if x)
        return math.sqrt(max(0, (part(p, q) + part(q, p)) / 2))

    made = []
    for text, lang in rows:
        words = split(text)
        chars = [0] * 6
        for c in text:
            if c not in spaces:
                chars[kind(c)] += 1
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        inside = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
        made.append((words, chars, histogram(words, lang) if lang in quality.COMMON_WORDS else None, len(inside), lang))

    def summed(part):
        chars, common = {}, {}
        for _, c, w, _, lang in part:
            chars[lang] = [x + y for x, y in zip(chars.get(lang, [0] * 6), c, strict=True)]
            if w:
                common[lang] = [x + y for x, y in zip(common.get(lang, [0] * len(w)), w, strict=True)]
        return ({k: v for k, v in x.items() if sum(v) >= quality.MIN_REFERENCE} for x in (chars, common))

    first, _ = summed(made)
    near = [m for m in made if not (m[4] in first and sum(m[1]) >= quality.MIN_CHARS and distance(m[1], first[m[4]]) > quality.TRIM)]
    chars, common = summed(near)
    out = []
    for words, c, w, inside, lang in made:
        failed = len(words) < 50 or 100 * inside > 50 * len(words)
        far = lang in chars and sum(c) >= quality.MIN_CHARS and distance(c, chars[lang]) > quality.CHAR_DISTANCE[0] + quality.CHAR_DISTANCE[1] / math.sqrt(sum(c))
        strange = w is not None and lang in common and len(words) >= quality.MIN_WORDS and distance(w, common[lang]) > quality.WORD_DISTANCE[0] + quality.WORD_DISTANCE[1] / math.sqrt(len(words))
        out.append(not failed and not far and not strange)
    return out


def test_quality_verdicts_against_brute_force(docs):
    whole = [(r["doc_id"], r["text"] or "", r["lang"]) for r in docs.collect()]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    want = brute_quality([(t, lang) for _, t, lang in whole])
    assert got == {i: k for (i, _, _), k in zip(whole, want, strict=True)} and 0 < sum(want) < len(want)


def test_quality_with_more_languages_than_fit_a_broadcast_by_hand(spark):
    """Thousands of languages, each judged by its own reference, whatever the partitioning."""
    rows = [(k * 10 + j, ("abcd efgh " if j else "abcd efg1 ") * 600, f"x{k}") for k in range(1_300) for j in range(4)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = quality.judge(table.repartition(6)).agg(F.count(F.when(F.col("char_distance").isNotNull(), 1)), F.count(F.lit(1))).first()
    assert tuple(out) == (5_200, 5_200)


def test_curly_quotes_are_punctuation():
    assert quality.class_counts("a\u201cB\u2014\u00e9 \u0663#\n".encode()).tolist() == [1, 1, 1, 1, 2, 1]


def test_quality_separates_labelled_documents(spark):
    path = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    out = [r for r in quality.judge(spark.read.parquet(f"{path}/documents.parquet")).collect() if r["doc_id"] in labels and not r["base_failed"]]
    good = [r["kept"] for r in out if labels[r["doc_id"]] == 1]
    assert sum(good) >= 0.98 * len(good)


def test_contamination(spark, docs, rows, small):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    windows = defaultdict(set)
    for r in bench.collect():
        w = word.findall(low(r["text"]))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(r["item_id"]))
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench).collect()}
    dirty = 0
    for i, text, _ in rows:
        w, hit, items = word.findall(low(text)), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    items |= windows[tuple(w[a : a + n])]
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"]) == (len(w), len(hit), len(items))
        assert got[i]["items_sha256"] == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        dirty += bool(hit)
    assert dirty
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and decontaminate.contamination(clean, bench).where("contaminated").count() == 0
    untouched = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert all(untouched[i] == t for i, t, _ in rows if not got[i]["contaminated"])


def test_contamination_awkward(spark, awkward, empty):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "alpha beta gamma"), (4, "one TWO"), (4, "one TWO")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.contamination(awkward, bench).collect()}
    assert got[4] == (2, 1) and got[None] == (3, 0) and got[1] == got[9] == (0, 0)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(awkward, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(awkward, bench).count() == len(AWKWARD) - 3


def test_contamination_in_many_rounds(spark, docs, small, awkward):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(decontaminate.contamination(docs, bench)) == rows(decontaminate.contamination(docs, bench, block=40))
    assert rows(decontaminate.decontaminate(docs, bench)) == rows(decontaminate.decontaminate(docs, bench, block=40))
    short = spark.createDataFrame([(i, f"w{i} alpha") for i in range(30)] + [(99, "one two")], "item_id long, text string")
    clash = awkward.withColumnsRenamed({"sig": "key", "n": "starts"})
    assert rows(decontaminate.contamination(clash, short)) == rows(decontaminate.contamination(clash, short, block=2))
    assert decontaminate.decontaminate(clash, short, block=2).columns == clash.columns


def test_lm_scores(docs, rows):
    got = {r["doc_id"]: r for r in lm_score.score(docs).collect()}
    of = lambda i: zlib.crc32(str(i).encode()) % 5
    tokens = {i: [*words(t), None] for i, t, _ in rows}
    counts = Counter(w for i, ws in tokens.items() if of(i) != 1 for w in ws)
    pairs = Counter((a, b) for i, ws in tokens.items() if of(i) != 1 for a, b in zip(["<s>", *ws[:-1]], ws, strict=True))
    n, v = counts.total(), len(counts)
    one = lambda w: (counts[w] + 0.5) / (n + 0.5 * (v + 1))
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (of(i) == 1, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10(one(w)) for w in ws), rel=1e-9)
        # no mixture is better than the best of its parts for each token, nor worse than the worst
        parts = [(pairs[a, b] / (counts[a] if a != "<s>" else counts[None]) if counts[a if a != "<s>" else None] else 0, one(b)) for a, b in zip(["<s>", *ws[:-1]], ws, strict=True)]
        assert r["score"] <= sum(math.log10(max(p)) for p in parts) + 1e-6
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_scores_against_brute_force(docs, rows):
    """The mixture's weights by expectation-maximisation over every single tuning token, without histograms."""
    of = lambda i: zlib.crc32(str(i).encode()) % 5
    tokens = {i: [*words(t), None] for i, t, _ in rows}
    pairs_of = lambda ws: list(zip([None, *ws[:-1]], ws, strict=True))  # noqa: E731  # the start's count is the end's
    level = lambda c: 0 if c == 0 else c.bit_length()

    def counted(folds):
        one = Counter(w for i, ws in tokens.items() if of(i) in folds for w in ws)
        two = Counter((a is None and j == 0, a, b) for i, ws in tokens.items() if of(i) in folds for j, (a, b) in enumerate(pairs_of(ws)))
        return one, two, one.total(), len(one)

    def parts(model, ws):
        one, two, n, v = model
        for j, (a, b) in enumerate(pairs_of(ws)):
            yield level(one[a]), two[j == 0, a, b] / one[a] if one[a] else 0.0, (one[b] + 0.5) / (n + 0.5 * (v + 1))

    main, both = counted({0, 3, 4}), counted({0, 2, 3, 4})
    seen = defaultdict(list)
    for i, ws in tokens.items():
        if of(i) == 2:
            for bucket, p, q in parts(main, ws):
                seen[bucket].append(p / q)
    weight = defaultdict(float)
    for bucket, ratios in seen.items():
        w = 0.5 if bucket else 0.0
        for _ in range(60):
            w = sum(w * r / (w * r + 1 - w) for r in ratios) / len(ratios)
        weight[bucket] = w
    got = {r["doc_id"]: r["score"] for r in lm_score.score(docs).collect()}
    for i, ws in tokens.items():
        want = sum(math.log10(weight[bucket] * p + (1 - weight[bucket]) * q) for bucket, p, q in parts(both, ws))
        assert got[i] == pytest.approx(want, rel=1e-3)


def test_lm_scores_awkward(awkward, empty):
    got = {r["doc_id"]: r for r in lm_score.score(awkward).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 1 and got[9]["n_tokens"] == 240_001 and all(math.isfinite(r["score"]) for r in got.values())
    assert lm_score.score(awkward).count() == len(AWKWARD) and lm_score.score(empty).count() == 0


def test_licenses_awkward(awkward, empty, spark):
    assert {r["n_licenses"] for r in licenses.scan_licenses(awkward).collect()} == {0}
    own = spark.createDataFrame([(1, "A text.\nReleased under the MIT License.\nMore."), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(own).collect()} == {1: ["MIT-short"], 2: []}
    assert licenses.scan_licenses(empty).count() == 0


def test_html_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.extract_text(pages).collect()}
    from html import unescape

    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        text = "\n\n".join(x for x in blocks if x)
        assert got[r["page_id"]]["text"] == text and got[r["page_id"]]["n_chars"] == len(text)
    odd = spark.createDataFrame([(1, None, None), (2, "not a url", "<p>x"), (2, "not a url", "<p>x"), (None, "http://h.example/", "")], "page_id long, url string, html string")
    assert sorted((str(r["page_id"]), r["text"]) for r in html_extract.extract_text(odd).collect()) == [("1", ""), ("2", "x"), ("2", "x"), ("None", "")]
    assert html_extract.extract_text(odd.limit(0)).count() == 0


def brute_wrapper(pages):
    """Texts of the pages by an induction that isn't ours: slots are paths of tags of well-formed pages, constants are what 95 % of the pages with the path show."""
    import xml.etree.ElementTree as ET

    shown = []
    for html in pages:
        own, stack = [], [(ET.fromstring(html), "")]
        while stack:
            x, path = stack.pop()
            path += "/" + x.tag
            if text := " ".join("".join(x.itertext()).split()) if x.tag in ("p", "h1", "li") else "":
                own.append((path, text))
            elif x.tag not in ("p", "h1", "li"):
                stack += [(c, path) for c in reversed(x)]
        shown.append(own)
    have, show, chars = Counter(), Counter(), Counter()
    for own in shown:
        have.update({p for p, _ in own})
        show.update(set(own))
    fixed = {x for x, n in show.items() if n >= 0.95 * have[x[0]] and n >= len(pages) / 2}
    for own in shown:
        for p, t in own:
            if (p, t) not in fixed:
                chars[p.rsplit("/", 1)[0]] += len(t)
    content = max(chars, key=chars.get)
    return ["\n\n".join(t for p, t in own if p.startswith(content + "/") and (p, t) not in fixed) for own in shown]


def site(i):
    """Nothing here has a telling tag or name; the order and number of blocks differ from page to page."""
    menu = "<div><ul><li>Home</li><li>News</li></ul></div>"
    note = "<p>Write to us about this story.</p>"
    body = "".join(f"<p>Part {j} of page {i} says {i * j} words.</p>" + note * (j == i % 3) for j in range(3 + i % 5))
    return f"<body>{menu}<section><h1>Page {i}</h1>{body}</section>{'<div><p>See also our partners</p></div>' * (i % 2)}<div><p>All rights are ours</p></div></body>"


def test_html_induction_against_brute_force_on_any_split(spark):
    pages = [(i, f"http://Plain.example:80/{i}", site(i)) for i in range(60)] + [(100 + i, "http://few.example/", site(i)) for i in range(3)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = dict(enumerate(brute_wrapper([x[2] for x in pages[:60]])))
    assert all("Write to us" not in x and "rights" not in x and x.startswith("Page") for x in want.values())
    got = [{r["page_id"]: r["text"] for r in html_extract.extract_text(table.repartition(n)).collect()} for n in (1, 3, 16)]
    assert got[0] == got[1] == got[2]
    assert {i: got[0][i] for i in want} == want
    assert got[0][100].startswith("Page 0")


def test_html_awkward_tables(spark):
    deep = "<div>" * 5_000 + "<p>deep</p>"
    long = "<article>" + "".join(f"<p>word {i}</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "http://h.example/a", deep, 1), (2, "http://h.example/b", long, 2), (2, "http://h.example/b", long, 2), (3, "http://h.example/c", "<a " * 100_000, 3), (4, "http://h.example/d", "<p>\ud83d\ude00 &#xd800; ok", 4)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host int").withColumnsRenamed({"host": "salt"})
    got = {r["page_id"]: r for r in html_extract.extract_text(table).collect()}
    assert got[1]["text"] == "deep" and got[2]["text"].count("\n\n") == 19_999 and got[4]["text"].endswith("ok")
    assert html_extract.extract_text(table).count() == 5


def test_tool_calls(spark):
    call = lambda i, name, arguments, **more: json.dumps({"tool_call": {"id": i, "name": name, "arguments": arguments} | more})
    rows = [
        (1, 0, "user", "hello"),
        (1, 1, "assistant", f"<tool_call>{call('b', 'search', {'query': '$a'})}</tool_call> and <tool_call>{call('a', 'calculator', {'expression': '1'})}</tool_call>"),
        (1, 2, "tool", json.dumps({"tool_result": {"id": "a", "content": 1}})),
        (1, 3, "assistant", call("c", "search", {}, after=["b", "nothing"])),
        (2, 0, "assistant", call("x", "none", {}, after=["y"])),
        (2, 1, "assistant", call("y", "search", '{"query":"q"}', after=["x"])),
        (2, 1, "assistant", call("y", "search", '{"query":"q"}', after=["x"])),
        (None, None, None, None),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    calls = {(r["conv_id"], r["call_id"]): r for r in chat.linked_calls(table).collect()}
    assert [calls[1, c]["depth"] for c in "abc"] == [0, 1, 2] and calls[2, "x"]["depth"] is None
    assert calls[1, "a"]["result_turn"] == 2 and calls[1, "b"]["result_turn"] is None
    assert calls[1, "b"]["valid"] and not calls[1, "c"]["valid"] and calls[2, "y"]["valid"] and calls[2, "x"]["errors"] == ["$: no such tool"]
    out = chat.format_chats(table)
    got = {(r["conv_id"], r["turn"]): r for r in out.collect()}
    assert out.count() == len(rows) and got[1, 1]["call_order"] == ["a", "b"] and got[1, 1]["n_linked"] == 1
    assert json.loads(got[1, 0]["message"]) == {"role": "user", "content": "hello"} and json.loads(got[None, None]["message"])["role"] == "unknown"
    assert chat.format_chats(table.limit(0)).count() == 0


def brute_depths(calls, links):
    """Depth by trying every order of chains: the longest one that ends, None where one doesn't."""
    needs = defaultdict(set)
    for c, n in links:
        needs[c].add(n)

    def deep(c, above):
        if c in above:
            return math.inf
        return max((1 + deep(n, above | {c}) for n in needs[c]), default=0)

    return [None if (d := deep(c, frozenset())) == math.inf else d for c in calls]


def test_tool_call_depths_against_brute_force(spark):
    import random

    rng = random.Random(4)
    rows, want = [], {}
    for conv in range(25):
        names = [f"c{i}" for i in range(rng.randrange(1, 8))]
        links = {(a, rng.choice(names)) for a in names for _ in range(rng.randrange(3))}
        links = [(a, b) for a, b in links if conv % 3 == 0 or a > b]
        for turn, a in enumerate(names):
            rows.append((conv, turn, "assistant", json.dumps({"tool_call": {"id": a, "name": "none", "arguments": {}, "after": [b for x, b in links if x == a]}})))
        want |= {(conv, c): d for c, d in zip(names, brute_depths(names, links), strict=True)}
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for limit in (chat.GROUP_LINKS, 2):  # in one task, and in rounds
        assert {(r["conv_id"], r["call_id"]): r["depth"] for r in chat.linked_calls(table, group_links=limit).collect()} == want
    chain = [(0, i, "assistant", json.dumps({"tool_call": {"id": f"c{i}", "name": "none", "after": [f"c{i - 1}"]}})) for i in range(3_000)]
    depths = [r["depth"] for r in chat.linked_calls(spark.createDataFrame(chain, "conv_id long, turn long, role string, text string")).collect()]
    assert sorted(depths) == list(range(3_000))


def test_hostile_messages(spark):
    deep = '{"tool_call":' * 30_000
    call = lambda arguments: json.dumps({"tool_call": {"id": "a", "name": "search", "arguments": arguments}})
    nested = '{"tool_call": {"id": "n", "name": "search", "arguments": ' + '{"a":' * 800 + '"$a"' + "}" * 800 + "}}"
    texts = [deep, call("[" * 1_000_000), nested, '{"tool_call": {"id": "\\ud800", "name": "\\udfff", "arguments": {"query": "$\\ud800"}}}', call({"query": "x" * 2_000_000}), '{"tool_call": {"id": 1e999, "name": null}}', '{"tool_call": {"id": ' + "9" * 5_000 + "}}"]
    rows = [(1, i, "assistant", t) for i, t in enumerate(texts)] + [(1, 0, "user", '{"tool_result": {"id": "a"}}'), (1, 0, "user", "plain"), (None, 0, "user", texts[3])]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"mark": F.lit(1), "n_calls": F.lit("x")})
    out = chat.format_chats(table).collect()
    assert len(out) == len(rows) and all(json.loads(r["message"]) is not None for r in out if len(r["message"]) < 3_000)
    at_zero = sorted((r["n_calls"], r["n_results"]) for r in out if r["turn"] == 0 and r["conv_id"] == 1)
    assert at_zero == [(0, 0), (0, 0), (0, 1)]
    nested_row = next(r for r in out if r["turn"] == 2)
    assert nested_row["n_calls"] == 1 and nested_row["call_order"] == ["n"]


def test_url_filter(spark):
    entries = [("Bad.example", "l", "add", "2024-01-10"), ("bad.example", "l", "remove", "2024-01-20"), ("bad.example", "l", "add", "2024-01-20"), ("bad.example", "l", "remove", "2024-02-01"), ("a.bad.example", "m", "add", "2024-01-15"), (None, "l", "add", "2024-01-01"), ("x", "l", "what", "2024-01-01")]
    urls = [("http://A.bad.example:80/p", "2024-01-16"), ("//u@www.bad.example/", "2024-01-09"), ("https://bad.example./", "2024-01-31"), ("https://bad.example/", "2024-02-01"), ("notbad.example", "2024-01-16"), ("http://notbad.example/", "2024-01-16"), (None, "2024-01-16"), ("http://bad.example", None)]
    table = spark.createDataFrame([(u, d, "old", i) for i, (u, d) in enumerate(urls)], "url string, fetched string, host string, i int")
    listed = spark.createDataFrame(entries, "domain string, list_name string, action string, dated string")
    got = {r["i"]: r["matched_domain"] for r in url_filter.judge_captures(table, listed).collect()}
    assert got == {0: "a.bad.example", 1: None, 2: "bad.example", 3: None, 4: None, 5: None, 6: None, 7: None}
    assert url_filter.judge_captures(table, listed.limit(0)).where("blocked").count() == 0
    assert url_filter.judge_captures(table.limit(0), listed).count() == 0


def test_captures_with_any_columns(spark):
    table = spark.createDataFrame([(1, "http://bad.example/" + "x" * 1_000_000, "2024-01-16", 1, "a", "b"), (1, "http://bad.example/", "2024-01-16", 1, "a", "b"), (1, "http://bad.example/", "2024-01-16", 1, "a", "b"), (2, "http://" + "a." * 5_000 + "bad.example/", "2024-01-16", None, None, None)], "i int, url string, fetched string, day int, domain string, `row.c0` string")
    listed = spark.createDataFrame([("bad.example", "l", "add", "2024-01-10")], "domain string, list_name string, action string, dated string")
    out = url_filter.judge_captures(table, listed)
    assert out.columns == [*table.columns, "host", "blocked", "matched_domain", "matched_list"] and out.where("blocked").count() == 4
    assert out.select("day", "domain").where("day = 1").count() == 3


def test_clashing_names_everywhere(spark):
    clash = spark.createDataFrame(AWKWARD, SCHEMA).withColumnsRenamed({"sig": "__n_lines", "n": "__mark"}).withColumns({"id": F.lit("i"), "h": F.lit(0), "c0": F.lit(0), "key": F.lit(0), "label": F.lit(0), "__id": F.lit("x")})
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert line_dedup.dedup_lines(clash).columns == [c for c in clash.columns if c != "__n_lines"] + ["__n_lines", "__n_removed"]
    assert ngram_join.keep_one(clash).columns == clash.columns and ngram_join.keep_one(clash).count() == 8
    assert quality.keep_good(clash).columns == clash.columns and decontaminate.decontaminate(clash, bench).columns == clash.columns
    for out in (quality.judge(clash), lm_score.score(clash), packing.pack(clash), licenses.scan_licenses(clash), decontaminate.contamination(clash, bench), ngram_join.near_duplicates(clash)):
        assert out.count() >= 7


def test_one_row_of_each_component_where_ids_clash(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    table = spark.createDataFrame([(2, a, "x"), (5, a, "y"), (5, b, "z"), (5, b, "w"), (7, b, "v"), (9, None, "n"), (9, "", "n"), (9, None, "m")], "doc_id long, text string, extra string")
    got = sorted((r["doc_id"], r["text"] or "") for r in ngram_join.keep_one(table).collect())
    assert got == [(2, a), (5, b), (9, ""), (9, "")]
    one, two = (sorted(map(str, ngram_join.keep_one(table.repartition(n)).collect())) for n in (1, 5))
    assert one == two


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_awkward_documents(spark, small, tmp_path, stage):
    import corpus_pipeline

    name, f = corpus_pipeline.STAGES[stage]
    docs = spark.createDataFrame([r[:5] for r in AWKWARD], "doc_id long, text string, lang string, source string, n_chars long")
    out = f(spark, docs, small)
    out.write.parquet(str(tmp_path / name))
    back = spark.read.parquet(str(tmp_path / name))
    assert back.count() >= 1 if name != "quality_rules" else back.count() >= 0
    assert name == "packing" or back.columns == docs.columns
    empty = f(spark, docs.limit(0), small)
    assert empty.count() == 0


def test_long_and_repeated_texts_for_licenses(spark):
    filler = " ".join(f"word{i}" for i in range(200_000))
    text = filler + " Released under the MIT License. " + filler
    rows = [(1, text), (1, text), (2, "license " * 50_000), (3, "\x00license\x00"), (None, "Released under the MIT License.")]
    out = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["licenses"]) for r in out) == [("1", ["MIT-short"]), ("1", ["MIT-short"]), ("2", []), ("3", []), ("None", ["MIT-short"])]


def test_pipeline(spark, small, tmp_path):
    """Each stage against brute force on what the stage before it kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, small)
        whole = [(r["text"] or "", r["lang"]) for r in docs.select("text", "lang").collect()] if name == "quality_rules" else []
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert {r["doc_id"] for r in docs.collect()} == set(before)
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality_rules":
            assert set(after) == {i for i, k in zip(before, brute_quality(whole), strict=True) if k}
        if name == "line_dedup":
            assert after == {i: t for i, _, _, t in brute_lines(list(before.items())) if t.split()}
        if name == "ngram_jaccard_join":
            assert after == {i: before[i] for i, _, c in brute_components(list(before.items())) if c == i}
        assert set(after) <= set(before) and len(after) > 0.5 * len(before)
        assert docs.where("n_chars <> char_length(text)").count() == 0
