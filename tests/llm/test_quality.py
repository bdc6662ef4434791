"""Quality rules: counts against plain Python, the ratio against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
import regex
import xxhash

from doctopics.llm.q_text import op5_quality_rules
from doctopics.llm.quality import EFFECT, FALSE_MARKERS, SMOOTHING, THRESHOLD, keep_good, quality_rules, toxic_markers, trusted_documents

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {p for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def grams(text, buckets):
    def h(*tokens):
        seed = 42
        for x in tokens:
            seed = xxhash.xxh64_intdigest(x.encode(), seed)
        return (seed - 2**64 if seed >= 2**63 else seed) % buckets

    t = regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+", text or "")
    return [h(x) for x in t] + [h(a, b) for a, b in zip(t, t[1:], strict=False)]


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def chain(words):
    seed = 42
    for x in words:
        seed = xxhash.xxh64_intdigest(x.encode(), seed)
    return signed(seed)


def all_grams(text):
    t = regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+", text or "")
    return [chain([x]) for x in t] + [chain(p) for p in zip(t, t[1:], strict=False)]


def copy_key(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return min((chain(w[k : k + 5]) for k in range(len(w) - 4)), default=chain(w))


def brute_markers(rows, labels):
    """Markers and threshold by plain counting; every label is used."""
    kind = {}
    for d, x in labels:
        kind[d] = max(x, kind.get(d, 0))
    classes = {}
    for d, text in rows:
        if d in kind:
            at = (copy_key(text), kind[d])
            classes[at] = min(classes.get(at, (d, text)), (d, text), key=lambda r: r[0])
    seen, total, held = (Counter(), Counter()), [0, 0], []
    for (key, x), (_, text) in classes.items():
        if key % 3:
            seen[x].update(set(all_grams(text)))
            total[x] += 1
        elif not x:
            held.append(text)
    (all_b, all_a), n = total, sum(total)
    tested = {g: a for g, a in seen[1].items() if a > 1}
    markers = {}
    for g, a in tested.items():
        b = seen[0][g]
        x = math.log((a + 0.5) / (all_a + 1)) - math.log((b + 0.5) / (all_b + 1))
        cells = [(a, a + b, all_a), (b, a + b, all_b), (all_a - a, n - a - b, all_a), (all_b - b, n - a - b, all_b)]
        g2 = 2 * sum(s * math.log(s * n / (r * c)) for s, r, c in cells if s)
        if x >= EFFECT and g2 >= 2 * math.log(len(tested) / FALSE_MARKERS):
            markers[g] = x
    scores = sorted((sum(markers.get(g, 0.0) for g in all_grams(t)) for t in held), reverse=True)
    allowed = int(0.005 * len(held))
    return markers, scores[allowed] if len(scores) > allowed else 0.0


def brute(rows, trusted, buckets, threshold=THRESHOLD):
    raw = Counter(g for _, t in rows for g in grams(t, buckets))
    target = Counter(g for d, t in rows if d in trusted for g in grams(t, buckets))
    r, k = sum(raw.values()) + SMOOTHING * buckets, sum(target.values()) + SMOOTHING * buckets
    w = {g: math.log((target[g] + SMOOTHING) / k) - math.log((raw[g] - 1 + SMOOTHING) / r) for g in raw}
    out = []
    for d, t in rows:
        c, own = counts(t), grams(t, buckets)
        llr = sum(w[g] for g in own) / len(own) if own else 0.0
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        out.append((d, *c, failed, not failed and llr >= threshold, round(llr, 6)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], *(r[c] for c in COUNTS), r["base_failed"], r["kept"], round(r["llr"], 6) + 0.0) for r in df.collect()), key=repr)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    trusted = {r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 0}
    markers, limit = brute_markers(rows, [(r["doc_id"], r["toxic"]) for r in labels])
    toxic = {d: sum(markers.get(g, 0.0) for g in all_grams(t)) > limit for d, t in rows}
    got = {r["doc_id"]: r for r in op5_quality_rules(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for d, *c, failed, kept, llr in brute(rows, trusted, 1 << 16):
        assert [got[d][x] for x in COUNTS] == c and got[d]["base_failed"] == failed
        assert got[d]["llr"] == pytest.approx(llr, abs=1e-5) and (got[d]["kept"] == (kept and not toxic[d]) or abs(llr - THRESHOLD) < 1e-5)
    poor = [got[r["doc_id"]] for r in labels if r["quality"] == 0]
    good = [got[d] for d in trusted if not got[d]["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good) and sum(r["kept"] for r in poor) <= 0.1 * len(poor)


@pytest.mark.parametrize("trusted", [[1, 2, 8, None], []])
def test_edges(spark, docs_of, trusted):
    prose = " ".join(f"wörd{k % 17} x{k}" for k in range(40))
    rows = [(1, prose), (2, prose + " more"), (3, None), (4, ""), (5, " \n\t\n"), (None, prose), (6, "a b c d e f g h " * 10), (6, "same " * 30)]
    rows += [(7, "l one\nl one\n\n \nl  one\nx\r\nx\r\n# $$ <p> | _ &&"), (8, "w " * 8), (9, "p q r s t u v w x y " * 2 + "z " + " ".join(map(str, range(90))))]
    rows += [(10, " nbsp wide \x1c sep\x85 \U0001f642\U0001f642 <<>> " + prose), (11, " ".join(f"u{k}" for k in range(30_000))), (2, prose + " more")]
    df = docs_of(rows, bucket=("int", [1] * len(rows)), kept=("int", [1] * len(rows)), _g=("int", [1] * len(rows)))
    ids = spark.createDataFrame([(x, 1) for x in trusted], "doc_id long, raw int")
    assert result(quality_rules(df, ids, buckets=512)) == brute(rows, {x for x in trusted if x is not None}, 512)
    assert quality_rules(docs_of([]), ids).count() == 0


def insulted(docs, seed=3, start=0):
    """Long texts of common words; every fourth has two insults."""
    rng = random.Random(seed)
    words, insults = [f"w{k}" for k in range(400)], ["idiot", "moron", "clown"]
    rows = []
    for k in range(start, start + docs):
        text = rng.choices(words, k=rng.randint(60, 600))
        for x in rng.sample(insults, 2) if k % 4 == 0 else ():
            text[rng.randrange(len(text))] = x
        rows.append((k, " ".join(text)))
    return rows


def label_rows(spark, ids):
    return spark.createDataFrame([(k, 1, int(k is not None and k % 4 == 0)) for k in ids], "doc_id long, quality int, toxic int")


def check_verdicts(spark, docs_of, rows, labels):
    out = {r["doc_id"]: r for r in quality_rules(docs_of(rows), trusted_documents(labels), toxic=labels).collect()}
    bad, clean = ([r for k, r in out.items() if (k % 4 == 0) == x] for x in (True, False))
    assert sum(r["kept"] for r in bad) <= 0.05 * len(bad)
    assert sum(r["toxic"] for r in clean) <= 0.01 * len(clean)
    return out


def test_toxic(spark, docs_of):
    """A few insults in long normal texts are caught, in documents without a label too; clean ones stay."""
    rows, labels = insulted(600), label_rows(spark, range(300))
    out = check_verdicts(spark, docs_of, rows, labels)
    kept = {r["doc_id"] for r in keep_good(docs_of(rows), trusted_documents(labels), toxic=labels).collect()}
    assert kept == {k for k, r in out.items() if r["kept"]}


def test_more_copies_are_no_more_evidence(spark, docs_of):
    """Exact and near copies of labelled texts, clean and toxic, change no marker; more labels drop no clean text."""
    rows, labels = insulted(600), label_rows(spark, range(300))
    once, limit = toxic_markers(docs_of(rows), labels)
    copies = [(k + 4000 * c, t + f" tail{c}") for c in range(1, 6) for k, t in rows[:300]]
    again, limit_again = toxic_markers(docs_of(rows + copies), label_rows(spark, [k for k in range(300)] + [k for k, _ in copies]))
    words = {chain([x]) for x in ("idiot", "moron", "clown")}
    assert {r["gram"] for r in once.collect()} == {r["gram"] for r in again.collect()} == words
    assert limit == limit_again == 0.0
    big = insulted(2400)
    check_verdicts(spark, docs_of, big, label_rows(spark, range(2000)))


@pytest.mark.parametrize("case", ["plain", "odd", "none"])
def test_markers_brute_force(spark, docs_of, case):
    rows = insulted(400, seed=9)
    ids = {"plain": range(300), "odd": [*range(200), *range(50), None, None, 10**12], "none": []}[case]
    if case == "odd":
        rows += [(None, "idiot " * 30), (3, None), (5, ""), (8, rows[8][1]), (12, "a b"), (13, "a b")]
    labels = label_rows(spark, ids)
    if case == "odd":  # an id labelled both ways is toxic
        labels = labels.unionByName(spark.createDataFrame([(7, 0, 1), (11, None, None)], labels.schema))
    markers, limit = toxic_markers(docs_of(rows), labels)
    pairs = [(r["doc_id"], r["toxic"]) for r in labels.collect() if r["doc_id"] is not None and r["toxic"] is not None]
    expected, expected_limit = brute_markers([r for r in rows if r[0] is not None], pairs)
    got = {r["gram"]: r["x"] for r in markers.collect()}
    assert got.keys() == expected.keys() and all(got[g] == pytest.approx(expected[g]) for g in got)
    assert limit == pytest.approx(expected_limit)


def test_a_text_is_split_into_words_once(spark, docs_of):
    docs = docs_of([(1, "a b c"), (2, None)])
    plan = quality_rules(docs, docs.select("doc_id"))._jdf.queryExecution().optimizedPlan().toString()
    words, other = r"regexp_extract_all(text#\d+, \[\^\\x20\\x09-\\x0D\]\+".replace("(", r"\("), "regexp_replace"
    assert len(re.findall(words, plan)) == 1 and other not in plan
