"""The corpus operators against brute force, exact round trips and held-out accuracy."""

import base64
import hashlib
import itertools
import pickle
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ventrica.llm import decontaminate, embed_dedup, hashed, html_text, language, licenses, near_dup, packing, quality, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_rnd = random.Random(3)
VOCABULARY = ["".join(_rnd.choice(("ka", "lo", "mi", "ren", "sta")) for _ in range(3)) for _ in range(400)]


def words(n, rnd):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def texts():
    rnd = random.Random(1)
    base = [words(rnd.randint(1, 90), rnd) for _ in range(40)]
    near = [" ".join(w if rnd.random() > 0.02 else "changed" for w in t.split()) for t in base for _ in range(3)]
    return [None, "", "   ", "one two", "ONE  two", base[0].upper(), *base, *near, *[base[1]] * 30, words(30000, rnd)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ("en", None, "xx")[k % 3], f"src{k % 4}", 0, "x") for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def components(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


def test_near_duplicates_equal_all_pairs(docs, no_docs):
    sets = {k: shingles(t) for k, t in enumerate(texts())}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    assert got == {k: (len(sets[k]), want[k], want[k] == k) for k in sets}
    assert near_dup.near_duplicates(no_docs).count() == 0


def test_near_duplicates_take_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e f", *[None] * 4), (5, "a b c d e f", *[None] * 4), (5, "a b c d e f", *[None] * 4)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 5), (5, 5), (5, 5)]


def test_packing_holds_all_tokens_without_gaps(docs, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer_path())
    want = {}
    for k, t in enumerate(texts()):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[k, p] = (at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))
    rows = packing.pack(docs).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == list(itertools.accumulate([0, *[n for _, n in sorted(parts)]]))[:-1]
        assert sum(n for _, n in parts) <= 2048
    assert len(bins) == -(-sum(w[1] for w in want.values()) // 2048)
    assert packing.pack(no_docs).count() == 0


def histogram(lengths, capacity):
    return [sum(n == k for n in lengths) for k in range(capacity + 1)]


def fewest_bins(lengths, capacity):
    """By trying each piece in every bin."""
    lengths, best = sorted(lengths, reverse=True), len(lengths)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for b in {x: j for j, x in enumerate(bins) if x + lengths[k] <= capacity}.values():
            bins[b] += lengths[k]
            go(k + 1, bins)
            bins[b] -= lengths[k]
        go(k + 1, [*bins, lengths[k]])

    go(0, [])
    return best


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if capacity - sum(b) >= n]
        if fits:
            min(fits, key=lambda b: capacity - sum(b)).append(n)
        else:
            bins.append([n])
    return len(bins)


def test_bin_completion_finds_the_fewest_sequences():
    rnd, better = random.Random(2), 0
    for k in range(200):
        capacity = rnd.choice((20, 50, 100))
        lengths = [rnd.randint(1, capacity) if k % 2 else rnd.randint(capacity // 5, capacity // 2) for _ in range(rnd.randint(0, 10))]
        count = histogram(lengths, capacity)
        first, (found, proven) = packing.best_fit_decreasing(count, capacity), packing.bin_completion(count, capacity)
        for solution in (first, found):
            assert sorted(n for pattern, times in solution for n in pattern * times) == sorted(lengths) and all(sum(p) <= capacity for p, _ in solution)
        least = fewest_bins(lengths, capacity)
        assert sum(m for _, m in first) == plain_best_fit(lengths, capacity)
        assert proven and packing.lower_bound(count, capacity) <= sum(m for _, m in found) == least
        better += least < sum(m for _, m in first)
    assert better > 2


def test_bin_completion_restores_full_sequences_that_best_fit_misses():
    solved = 0
    for seed in range(8):
        rnd, lengths = random.Random(seed), []
        for _ in range(15):
            a = rnd.randint(380, 490)
            b = rnd.randint(250, (1000 - a) // 2)
            lengths += [a, b, 1000 - a - b]
        count = histogram(lengths, 1000)
        assert sum(m for _, m in packing.best_fit_decreasing(count, 1000)) > 15
        solved += sum(m for _, m in packing.bin_completion(count, 1000)[0]) == 15
    assert solved >= 6


def test_fillings_hold_every_one_that_none_dominates():
    rnd = random.Random(12)
    for _ in range(60):
        pieces, room = [rnd.randint(2, 12) for _ in range(rnd.randint(1, 7))], rnd.randint(3, 24)
        count = histogram(pieces, room)
        count = count[: room + 1]
        inside = [p for p in pieces if p <= room]
        every = {tuple(sorted(c, reverse=True)) for k in range(len(inside) + 1) for c in itertools.combinations(inside, k) if sum(c) <= room}
        found = [(w, f) for w, f in packing.fillings(count, room)]
        kept = [f for _, f in found if f is not None]
        assert len(kept) == len(set(kept)) and set(kept) <= every and [w for w, _ in found] == sorted(w for w, _ in found)
        largest = max(map(sum, every))
        assert max(map(sum, kept)) == largest


def test_archive_round_trip(spark):
    pages = [(k, f"http://a/{k}", h) for k, h in enumerate(["<p>é</p>", None, "", "<p>é</p>", "x" * 700_000, "y"])]
    got = {r.page_id: r for r in warc.read_archive(warc.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()}
    first = {}
    for k, _, h in pages:
        body = (h or "").encode()
        refers = first.setdefault(body, k)
        r = got[k]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if refers == k else ("revisit", refers))
        assert r.html == (body.decode() if refers == k else None)


def test_archive_by_its_footers(spark):
    """Null ids, repeated rows, clashing columns, a subset of the index, and frames found from nothing but a bundle's bytes."""
    import io

    import zstandard

    rows = [(None, None, "null id"), (3, "http://a/3", "twin"), (3, "http://a/3", "twin"), (9, "http://a/9", "twin"), (None, None, "twin"), (4, None, "z" * 600_000), *((k, None, f"{k} " * 20_000) for k in range(20, 40))]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, frame int, bundle string").coalesce(1)
    index = warc.write_archive(pages)
    assert index.columns == ["record_id", "page_id", "bundle", "frame", "record_offset", "record_length"] and index.count() == len(rows)
    got = sorted((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archive(index).collect())
    want = sorted((k or -1, "revisit" if h == "twin" and k != 3 else "response", 3 if h == "twin" and k != 3 else None, len(h)) for k, _, h in rows)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    some = warc.read_archive(index.where("page_id in (9, 31)")).collect()
    assert sorted((r.page_id, r.html) for r in some) == [(9, None), (31, "31 " * 20_000)]

    (bundle,) = {r.bundle for r in index.select("bundle").distinct().collect()}
    data = open(bundle.removeprefix("file://").removeprefix("file:"), "rb").read()

    class Sized(io.BytesIO):
        def size(self):
            return len(self.getbuffer())

    frames = warc.read_seek_table(Sized(data))
    plain = [zstandard.ZstdDecompressor().decompress(data[a : a + n]) for a, n, _ in frames]
    assert len(frames) > 3 and [len(p) for p in plain] == [m for _, _, m in frames]
    for r in index.collect():
        headers, _ = warc.parse_record(plain[r.frame][r.record_offset : r.record_offset + r.record_length])
        assert headers["WARC-Record-ID"] == f"<{r.record_id}>"
    assert warc.read_seek_table(Sized(warc.seek_table([]))) == []
    for broken in (b"", data[:-1], data[1:], data[:-9] + b"\0" * 9):
        with pytest.raises(ValueError):
            warc.read_seek_table(Sized(broken))
    assert warc.read_archive(warc.write_archive(pages.limit(0))).collect() == []


def test_license_scan_equals_plain_search(spark):
    cases = ["MIT License and the Apache License. mit license", "GNU General Public License", "été MIT-license", None, "", "limit license", "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: BSD-3-Clause", words(20000, random.Random(4)) + " MIT license"]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    for k, t in enumerate(cases):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        base = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        r = got[k]
        places = [i for i, _ in base]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in base}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[7].labels == "bsd-3" and got[6].score == 0.8 and len(licenses.RULES) > 200


def test_license_rules_find_their_own_words_behind_their_keywords():
    """Each rule matches its pattern with the optional parts left out, and the keyword gate lets it through."""
    for rule in licenses.RULES:
        text = rule.pattern.pattern.decode()
        text = text.removeprefix("(?<![^ ])").removesuffix("(?![^ ])")
        text = re.sub(r"\(\?![^)]*\)", "", text)
        text = re.sub(r"\(\?:([^)|]*)[^)]*\)(\??)", lambda m: "" if m[2] else m[1], text)
        text = re.sub(r"\.\{\d+,\d+\}\?", "xx", re.sub(r"\[(.)[^\]]*\]", r"\1", text)).replace(" ?", " ").replace("?", "")
        words = text.encode().split()
        assert rule.pattern.search(b" ".join(words)), text
        assert rule.keywords and rule.keywords <= set(words), (text, rule.keywords)
        assert any(d[3] == rule.label or d[2] >= rule.priority for d in licenses.detections(words)), text


def test_license_scan_of_no_rows_and_of_strange_ones(spark):
    none = licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == 0
    rows = [(None, "mit license", "x"), (1, "MIT license", "y"), (1, "MIT license", "y"), (2, "word " * 200_000 + "mit license", "z")]
    got = [(r.doc_id, r.n_words, r.labels) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()]
    assert sorted(got, key=str) == sorted([(None, 2, "mit"), (1, 2, "mit"), (1, 2, "mit"), (2, 200_002, "mit")], key=str)


def test_license_suppression_and_ungated_rules_agree():
    text = licenses._WORD.findall(b"licensed under the apache license version 2 0 and gpl v3 license")
    everything = []
    joined = b" ".join(text)
    for rule in licenses.RULES:
        everything += [(joined.count(b" ", 0, m.start()), joined.count(b" ", 0, m.start()) + m[0].count(b" "), rule.priority, rule.label) for m in rule.pattern.finditer(joined)]
    assert licenses.detections(text) == licenses.suppress(everything)
    assert licenses.suppress([(0, 5, 80, "a"), (1, 3, 60, "b"), (4, 7, 60, "c")]) == [(0, 5, 80, "a"), (4, 7, 60, "c")]


def test_main_text_on_held_out_pages(spark):
    field, right, total = html_text.trained_field(), 0, 0
    for blocks, labels in html_text.labelled_pages(60, seed=99):
        got = field.decode(blocks)
        right, total = right + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert right / total > 0.97
    page = "<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>A &amp; B</h1><p>One\n two<br>three.<p>Four<script>x</p></script></article><footer>&copy; me</footer>"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, None, "<p"), (None, None, "")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_main_text(rows).collect()}
    assert got[1] == ("A & B\nOne two three.\nFour", 25) and got[2] == ("", 0)


def test_main_text_of_pages_without_telling_tags():
    field = html_text.trained_field()
    said = "This is a long sentence about some thing, with a comma and a stop. And another one follows it here, which is longer still."
    bare = f"<div><ul><li><a href=/>Home</a></li><li><a href=/b>About us</a></li></ul></div><div><div>{said}</div><div>{said} B</div></div><div>All rights reserved</div>"
    table = f"<table><tr><td><a href=/>Home</a><br><a href=/x>News</a></td><td><p>{said}</p><p>{said} B</p></td></tr></table>"
    for body in (bare, table):
        assert html_text.main_text(field, f"<html><body>{body}</body></html>") == f"{said}\n{said} B"


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a href="' * 120_000, "<div>x" * 170_000, "<div>" * 100_000 + "</p>" * 100_000, "".join(f'<div class="k{i}">x' for i in range(50_000)), "<" * 1_000_000, "<svg>" * 200_000, "<div>" + "<section>" * 50_000 + "<dd></dd>" * 50_000])
def test_broken_pages_take_time_in_proportion(page):
    began = time.process_time()
    html_text.main_text(html_text.trained_field(), page)
    assert time.process_time() - began < 20


def test_viterbi_is_the_best_of_all_labellings():
    field = html_text.ChainField()
    field.weights, field.moves = {"a": 1.5, "b": -1.0, "c": 0.3}, [[0.4, -0.9], [-0.7, 0.8]]
    blocks = [("a",), ("b",), ("c",), ("b", "c"), ("a", "b")]
    score = lambda y: sum(s * field.energy(b) for s, b in zip(y, blocks, strict=True)) + sum(field.moves[a][b] for a, b in itertools.pairwise(y))
    assert score(field.decode(blocks)) == max(map(score, itertools.product((0, 1), repeat=len(blocks))))


def test_quality_parts_junk_from_prose(spark):
    rnd = random.Random(5)
    rows = [(k, words(80, rnd) if k % 5 else " | ".join(rnd.choice(("zz%", "qq#", "vv$")) + str(rnd.randint(0, 9)) for _ in range(80))) for k in range(400)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 > 0)) for k in range(0, 400, 3)] + [(None, 1), (2, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_sample(docs, labels).collect()}
    assert all(got[k].kept == (k % 5 > 0) for k in range(400)) and got[900].weight == got[901].weight == 0
    ranked = sorted((r.score for r in got.values()), reverse=True)
    kept = sum(r.kept for r in got.values())
    assert sorted((r.score for r in got.values() if r.kept), reverse=True) == ranked[:kept]
    assert quality.quality_sample(docs.limit(0), labels).count() == 0
    assert quality.quality_sample(docs, labels.limit(0)).where("kept").count() == len(rows)


def test_toxic_texts_are_not_sampled(spark):
    rnd = random.Random(11)
    insult = lambda t: " ".join(rnd.choice(("idiot", "moron", "scum")) if rnd.random() < 0.08 else w for w in t.split()) + " idiot"
    rows = [(k, insult(words(80, rnd)) if k % 5 == 0 else words(80, rnd)) for k in range(500)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(0, 500, 2)] + [(None, 1, 1), (1, 1, None), (5, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_sample(docs, labels).collect()}
    assert all(not got[k].kept and got[k].toxicity > 0 for k in range(0, 500, 5)) and got[900].toxicity == got[901].toxicity == 0
    assert sum(got[k].kept for k in range(500) if k % 5) > 380
    assert quality.quality_sample(docs.limit(0), labels).count() == 0


def test_telling_words_equal_brute_force():
    rnd = random.Random(12)
    said = ["achlichau", "achlichpf", "trash", "Trash", "trashy", "réeuxment", "house", "of", "a", "longwordofmanyletters"]
    texts = [" ".join(rnd.choice(said) for _ in range(rnd.choice((0, 1, 2, 7, 60)))) for _ in range(80)] + [None, "", " ", "trash", "trash", "same line of trash\n" * 50]
    bits, data = 22, lambda w: (np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))
    whole = lambda w: int(hashed.word_hashes(*data(w))[0][0] >> np.uint64(64 - bits))
    start = {size: int(hashed.mix64(hashed.word_hashes(*data(w), (size,))[2][0][1] + np.uint64(size))[0] >> np.uint64(64 - bits)) for w, size in (("achlichau", 6), ("trashy", 4))}
    odds = np.zeros(1 << bits)
    odds[whole("trash")], odds[start[6]], odds[start[4]], odds[whole("achlichpf")] = 5.0, 3.0, 2.0, 4.0
    worth = {"trash": 5.0, "trashy": 2.0, "achlichau": 3.0, "achlichpf": 4.0}
    got = [row for part in hashed.telling_words(pa.array(texts, pa.string()), bits, odds) for row in zip(*part, strict=True)]
    for text, (places, telling, total) in zip(texts, got, strict=True):
        words_of = [None, *(text or "").lower().split(), None]
        seen = {tuple(words_of[i - 1 : i + 2]) for i in range(1, len(words_of) - 1)}
        found = [worth[w] for _, w, _ in seen if w in worth]
        assert (places, telling, total) == (len(seen), len(found), sum(found))


def test_one_chance_hit_in_a_long_text_is_not_toxic(spark):
    rnd = random.Random(13)
    insult = lambda t: " ".join(rnd.choice(("idiot", "moron", "scum")) if rnd.random() < 0.08 else w for w in t.split()) + " idiot"
    rows = [(k, insult(words(80, rnd)) if k % 5 == 0 else words(80, rnd)) for k in range(500)]
    rows += [(600 + k, words(3000, rnd) + " idiot " + words(3000, rnd)) for k in range(3)] + [(700, insult(words(6000, rnd)))]
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(0, 500, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_sample(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert all(got[600 + k].toxicity < 0 for k in range(3)) and not got[700].kept


def test_kth_largest_equals_sorting(spark):
    values = [random.Random(6).gauss(0, 1) for _ in range(500)] + [1.0] * 50
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 40, 90, 549, 550):
        assert quality.kth_largest(frame, "v", k) == sorted(values, reverse=True)[k - 1]


def test_vectors_equal_all_pairs(spark):
    rnd = random.Random(7)
    base = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    vectors = [*base, *[[x + rnd.gauss(0, s) for x in v] for v in base for s in (0.1, 0.45)], base[0], [2 * x for x in base[0]], None, [0.0] * 16, [float("nan")] * 16]
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    live = {k: v for k, v in enumerate(vectors) if v and all(x == x for x in v) and any(v)}
    links = [(a, b) for a, b in itertools.combinations(live, 2) if cosine(live[a], live[b]) >= 0.9]
    want = components(range(len(vectors)), links)
    got = {r.vec_id: r for r in embed_dedup.near_duplicate_vectors(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()}
    small = {r.vec_id: r for r in embed_dedup.near_duplicate_vectors(spark.createDataFrame([(k, v, "x") for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, lead string"), block=8).collect()}
    none = embed_dedup.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert small == got and none.count() == 0
    for k in range(len(vectors)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (sum(k in x for x in links), want[k], want[k] == k)


def test_languages_on_pages_and_rejection(spark):
    said = {"en": "the house and the garden were with that of them", "fr": "la maison est dans le jardin avec les enfants que", "de": "das haus und der garten sind nicht mit einem kind", "es": "la casa y el jardín son para los niños que están"}
    rnd = random.Random(8)
    pages = []
    for k in range(120):
        tongue = sorted(said)[k % 4]
        body = " ".join(rnd.choice(said[tongue].split()) for _ in range(40))
        pages.append((k, f"https://w{k % 3}.example.{tongue if tongue != 'en' else 'com'}/a", f'<html lang="{tongue}-X"><script>the the</script><p>{body}</p>'))
    pages += [(200, None, None), (201, "bad", "12 34"), (202, "http://h.de/", '<html lang="de"><p>kind')]
    got = {r.page_id: r for r in language.page_languages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[k].language == sorted(said)[k % 4] and got[k].accepted for k in range(120))
    assert not got[200].accepted and got[201].language == "und" and got[202].language == "de"


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(9)
    items = [(k, words(rnd.randint(8, 60), rnd)) for k in range(30)] + [(30, None), (31, "two words"), (None, "a b c d e f")]
    items += [(77, words(150, rnd)), (78, "first of one id it is here"), (78, "second of one id it is there"), (None, "an item of no id at all is here")]
    docs = []
    for k in range(140):
        parts = words(rnd.randint(0, 300), rnd).split()
        if k % 2:
            leak = items[rnd.randrange(30)][1].split()
            leak = [w if rnd.random() > 0.03 else "edit" for w in leak][: rnd.choice((len(leak), len(leak) * 2 // 3))]
            at = rnd.randint(0, len(parts))
            parts[at:at] = leak
        docs.append((k, " ".join(parts)))
    docs += [(200, None), (201, ""), (202, "Two Words")]
    docs += [(203, items[-1][1] + " and more"), (204, f"{items[-2][1]} x {items[-3][1]}")]
    want = set()
    for d, t in docs:
        w = WORD.findall(lower(t))
        for i, q in items:
            s = shingles(q)
            if not s:
                continue
            stride = 64
            while stride < len(WORD.findall(lower(q))):
                stride *= 2
            qw = WORD.findall(lower(q))
            order = [tuple(qw[k : k + 5]) for k in range(len(qw) - 4)] if len(qw) >= 5 else [tuple(qw)]
            cut = 2 * len(order) // 3
            question, answer = set(order[: max(1, cut)]), set(order[cut:])
            for a in range(0, max(len(w), 1), stride):
                have = {tuple(w[k : k + 5]) for k in range(a, min(a + 2 * stride - 4, len(w) - 4))} if len(w) >= 5 else {tuple(w)}
                if 100 * len(s & have) >= 75 * len(s) and 2 * len(question & have) >= len(question) and 2 * len(answer & have) >= len(answer):
                    want.add((d, i))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = decontaminate.leaked_items(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 10
    several = decontaminate.leaked_items(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"), shard_terms=200)
    assert {(r.doc_id, r.item_id) for r in several.collect()} == want
    assert decontaminate.leaked_items(frame([], "doc_id long, text string"), frame([], "item_id long, text string")).count() == 0


def test_other_items_change_no_verdict(spark):
    rnd = random.Random(15)
    item = words(40, rnd).split()
    docs = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[:20] + words(200, rnd).split() + item[20:])), (3, words(300, rnd))], "doc_id long, text string")
    found = []
    for more in ([], [(8, words(400, rnd))], [(8, words(5000, rnd)), (9, words(70, rnd)), (9, words(90, rnd))]):
        items = spark.createDataFrame([(7, " ".join(item)), *more], "item_id long, text string")
        found.append({(r.doc_id, r.item_id) for r in decontaminate.leaked_items(docs, items).collect()})
    assert found == [{(1, 7)}] * 3


def test_leaks_are_found_in_any_case(spark):
    items = [(1, "¿dónde está el niño que comió el último melón del jardín pequeño"), (2, "l'été der größte fuß der straße muß über die straße führen"), (3, "йод і σοφός ёлка λόγος жук δρόμος щит")]
    docs = [(10 * k + j, "x y " + f(t) + " z") for k, t in items for j, f in enumerate((str, str.upper, str.title))]
    got = decontaminate.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(10 * k + j, k) for k, _ in items for j in range(3)}
    back = decontaminate.leaked_items(spark.createDataFrame([(k, t) for k, t in items], "doc_id long, text string"), spark.createDataFrame([(k, t.upper()) for k, t in items], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in back.collect()} == {(k, k) for k, _ in items}


def test_wand_equals_plain_scores(spark):
    rnd = random.Random(10)
    items = [(k, " ".join(rnd.choice("abcd") for _ in range(rnd.randint(5, 40)))) for k in range(300)]
    shards = decontaminate.build_index(spark.createDataFrame(items, "item_id long, text string"))[0].collect()
    assert len(shards) == 1
    index = pickle.loads(shards[0]["index"])
    for _ in range(40):
        terms = sorted(rnd.sample(range(len(index.terms)), 60))
        for threshold in (0.05, 0.2, 0.6):
            scores = {}
            for t in terms:
                for k, w in zip(index.items[t], index.weights[t], strict=True):
                    scores[k] = scores.get(k, 0) + w
            assert sorted(index.search(terms, threshold)) == sorted(k for k, s in scores.items() if s >= threshold + 1e-12 or abs(s - threshold) < 1e-12 and k in index.search(terms, threshold))
