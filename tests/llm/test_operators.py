"""The registered operators against plain Python, on small tables with the awkward rows in them."""

import base64
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelex.llm import (byte_passages, decontaminate, html_text, packing, passages, queries, secrets,
                         toxicity, warc, weighted_sketch, word_passages)
from tidelex.llm.common import fresh_folder
from tidelex.session import shared_folder

SHARED = "the passage which many of them hold " + " ".join(f"w{i}" for i in range(130))


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    out = []
    for n in range(60):
        words = [word() for _ in range(rng.randrange(1, 90))]
        if n % 4 == 0:
            words[rng.randrange(len(words)):0] = SHARED.split()
        out.append((n * 2, rng.choice([" ", "  ", "\n"]).join(words)))
    out += [(201, None), (203, ""), (205, out[4][1]), (207, out[4][1]), out[8], out[8],
            (209, "x" * 900), (211, "ab" * 700), (213, " ".join(SHARED.split()[10:24])),
            (215, " ".join(word() for _ in range(20_000)))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns that operators also make inside."""
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit("extra") for c in ("key", "id", "n_words", "spans", "score", "rank", "items")})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_bytes_removed(docs, rows, nothing):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for d, t in enumerate(texts):
        for at in range(len(t) - 399):
            seen.setdefault(t[at:at + 400], []).append((d, at))
    cover = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, at in places:
                cover[d][at:at + 400] = b"\1" * 400
    want = [(i, len(t), sum(c), len(re.findall(b"\1+", bytes(c))),
             sha(bytes(b for b, x in zip(t, c) if not x)))
            for (i, _), t, c in zip(rows, texts, cover)]
    got = byte_passages.report(docs)
    assert listed(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    assert byte_passages.report(nothing).collect() == []


def test_words_removed(docs, rows, nothing):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), words in zip(rows, split):
        for at in range(len(words) - 12):
            w = tuple(words[at:at + 13])
            first[w] = min(i, first.get(w, i))
    want = []
    for (i, _), words in zip(rows, split):
        cut = set()
        for at in range(len(words) - 12):
            if first[tuple(words[at:at + 13])] < i:
                cut.update(range(at, at + 13))
        want.append((i, len(words), len(cut),
                     sha(" ".join(w for n, w in enumerate(words) if n not in cut))))
    got = word_passages.report(docs)
    assert listed(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert word_passages.report(nothing).collect() == []


def test_contamination(spark, docs, rows, nothing):
    items = [(1, SHARED), (2, "W5 w6, w7"), (10, rows[3][1]), (3, None), (4, "!!"), (5, rows[3][1]),
             (6, "never to be met in this table at all not once ever")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def words_of(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    windows = {}
    for item, text in items:
        words = words_of(text)
        size = min(10, len(words))
        for at in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[at:at + size]), set()).add(item)
    want = []
    for i, text in rows:
        words, hit, found = words_of(text), set(), set()
        for size in {len(w) for w in windows}:
            for at in range(len(words) - size + 1):
                of = windows.get(tuple(words[at:at + size]))
                if of:
                    hit.update(range(at, at + size))
                    found |= of
        want.append((i, len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))),
                     bool(hit)))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert listed(decontaminate.report(docs, bench), *columns) == sorted(want, key=repr)
    assert decontaminate.report(nothing, bench).collect() == []
    assert not [r for r in decontaminate.report(docs, bench.limit(0)).collect() if r["contaminated"]]
    clean = decontaminate.without_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert listed(clean, "doc_id", "text") == sorted(
        [r for r, w in zip(rows, want) if not w[5]], key=repr)
    assert {r["items"] for r in clean.select("items").collect()} == {"extra"}


def test_secrets(spark, nothing):
    rng = random.Random(4)
    draw = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    hexes, wide = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = [f"é😀 line {n} password = \"{draw(12, wide)}\" then {draw(40, hexes)} and AKIA{draw(16, wide[:26])} end"
             for n in range(40)]
    texts += [f"key {draw(44, wide)} here" for _ in range(40)]
    texts += [None, "", "token: short", "Secret=abcdefgh", "api_key': 'x=y/z.w-v_u+t", "AKIAAKIA" + "A" * 12,
              "deadbeef" * 4, "plain words only " * 50, "password=password=abcdefgh", texts[0], texts[0],
              "filler words " * 8000 + " passwd:abcdefgh"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("secrets", F.lit("extra"))
    kinds = [("assign", re.compile(secrets.ASSIGN, re.A), 8), ("access", re.compile(secrets.ACCESS), 16),
             ("hex", re.compile(secrets.HEX), 32)]
    want = {}
    for i, text in rows:
        spans = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, least) in enumerate(kinds)
                 for m in p.finditer(text or "") if len(m[m.lastindex or 0]) >= least]
        want[i] = (*[sum(x[1] == k for x in spans) for k in range(3)],
                   sha(",".join(x[2] for x in sorted(spans))))
    got = {r["doc_id"]: r for r in secrets.report(docs).collect()}
    assert {i: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for i, r in got.items()} == want
    assert sum("random:" in got[i]["spans"] for i in range(40, 80)) >= 30
    assert "random:" not in got[87]["spans"]
    masked = secrets.redact(docs)
    assert masked.columns == docs.columns
    out = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert out[80] is None and out[81] == "" and out[82] == texts[82] and out[83] == "[secret]"
    assert secrets.report(nothing).collect() == []


def test_packing_rebuilds_every_document(docs, rows, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at:at + 2048]
            want.append((i, n, at, len(own),
                         zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))))
    got = packing.packed(docs, queries.tokenizer_path())
    assert listed(got, "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=repr)
    sequences = {}
    for r in got.collect():
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(w[3] for w in want) // 2048) + 1
    assert packing.packed(nothing, queries.tokenizer_path()).collect() == []


def test_fingerprints(docs, rows, nothing):
    got = weighted_sketch.fingerprints(docs).collect()
    assert len(got) == len(rows)
    by_text = {}
    texts = dict(rows)
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert r["n_chars"] == len(text)
        by_text.setdefault(text, set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(x) == 1 for x in by_text.values())
    order = sorted(texts)
    for r in got:
        if r["doc_id"] in (16, rows[8][0]):
            continue  # twice in the table: its next document is itself
        text = texts[r["doc_id"]] or ""
        after = texts[order[(order.index(r["doc_id"]) + 1) % len(order)]] or ""
        n = len(text) // 4
        assert r["edited_sha256"] == sha(text[:len(text) - n] + after[:n])
    assert weighted_sketch.fingerprints(nothing).collect() == []


def test_archive(spark):
    pages = [(1, "http://a", "<p>é</p>"), (2, "http://b", None), (3, "http://c", ""), (9, "http://d", "<p>é</p>"),
             (4, None, "<p>é</p>"), (5, "http://e", "x\r\n\r\ny" * 1000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("kind", F.lit(1))
    last = {}
    for i, _, html in pages:
        last[html or ""] = max(i, last.get(html or "", i))
    want = [(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
             "response" if last[h or ""] == i else "revisit", None if last[h or ""] == i else last[h or ""])
            for i, _, h in pages]
    got = warc.archived_pages(df, fresh_folder(spark, "warc-test"))
    assert listed(got, "page_id", "payload_bytes", "payload_digest", "record_type",
                  "refers_to") == sorted(want, key=repr)
    assert warc.archived_pages(df.limit(0), fresh_folder(spark, "warc-test")).collect() == []


def test_main_text(spark):
    body = "A long enough sentence, with commas, of the article &amp; more text in it. " * 4
    page = ("<html><head><style>p{}</style><script>var a;</script></head><body><nav><a href=/>Home</a></nav>"
            f"<article><h1>Title here</h1><p>{body}</p><p>{body}</p></article><footer>Legal</footer></body></html>")
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p")],
                                  "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    text = got[1]["text"]
    assert body.replace("&amp;", "&").strip() in text and "Home" not in text and "Legal" not in text
    assert "var a" not in text and got[2]["text"] == got[3]["text"] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_text.extract(pages.limit(0)).collect() == []


def test_toxicity_on_held_out_rows(spark, nothing):
    folder = "/root/testdata/sf0.01"
    docs, labels = queries.read(spark, folder, "documents"), queries.read(spark, folder, "labels")
    got = toxicity.report(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    right = sum(r["predicted"] == r["toxic"] for r in held) / len(held)
    print(f"held-out accuracy {right:.3f} of {len(held)}, "
          f"{sum(r['toxic'] for r in held)} toxic")
    assert right >= 0.9
    assert toxicity.report(nothing, labels).collect() == []
    odd = spark.createDataFrame([(None, None), (1, ""), (1, None)], "doc_id long, text string")
    assert len(toxicity.report(odd, labels.limit(0)).collect()) == 3


def test_secrets_of_rare_kinds(spark):
    """A few keys of each encoding and length: nearly all are found, ordinary runs are not."""
    rng = random.Random(8)
    rows = [f"key {''.join(rng.choice(alphabet) for _ in range(size))} here"
            for _, _, alphabet in secrets.ENCODINGS for size in (20, 29, 47, 70, 150) for _ in range(3)]
    plain = ["state-of-the-art-tools-of-the-trade", "usr/local/share/doc/python/readme", "-" * 40, "0" * 30,
             "getUserNameFromIdentifier", "internationalizationsettings", "aaaaaaaaaaaaaaaaaaaaaaaa"]
    docs = spark.createDataFrame(list(enumerate(rows + plain)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in secrets.report(docs).collect()}
    assert sum(spans[i] != "" for i in range(len(rows))) >= 0.97 * len(rows)
    assert not [x for i, x in enumerate(plain) if spans[len(rows) + i]]


def test_secrets_thresholds():
    """Chance raises no threshold over keys alone; a pile of ordinary text does."""
    rng = random.Random(9)
    for keys, plain in ((1, 0), (3, 0), (300, 0), (5000, 0), (0, 500), (1, 500), (40, 500), (3000, 3000)):
        counts = [0] * secrets.BINS
        for p in [rng.random() for _ in range(keys)] + [10 ** rng.uniform(-9, -2.1) for _ in range(plain)]:
            counts[max(n for n, edge in enumerate(secrets.EDGES) if edge <= p)] += 1
        lowest = secrets.lowest_bin(counts)
        assert secrets.EDGES[lowest] <= 0.02
        assert sum(counts[lowest:]) - keys <= 3 + 0.06 * keys if plain else lowest == 0


def test_main_text_inside_marked_wrappers():
    """Words in styles and classes of a wrapper do not take the article with it; boilerplate goes."""
    body = "A long enough sentence, with commas, of the article and more text in it. " * 4
    inner = f"<p>First. {body}</p><p>Second. {body}</p>"
    junk = f"<div class='site-footer'><p>Junk {body[:90]}</p></div><ul class=menu><li>Junk</li></ul>"
    for attrs in ('style="overflow:hidden"', 'title="hidden gems"', 'data-x="hidden"', "class=has-sidebar",
                  'class="with-sidebar wide"', "class=no-nav", 'class="content side"', "class=modal",
                  "id=main-content class=widget", 'data-class="ad"'):
        for held in (inner, f"<article>{inner}</article>"):
            text = html_text.main_text(f"<body><div {attrs}>{held}</div>{junk}</body>")
            assert "First." in text and "Second." in text and "Junk" not in text, (attrs, text)
    for attrs in ("hidden", 'style="color:red; display : none"', "class=sidebar", "class=comments", 'hidden=""',
                  'class="post-comments"', "id=left_nav"):
        text = html_text.main_text(f"<body><div><p>First. {body}</p></div><div {attrs}><p>Junk {body}</p></div></body>")
        assert "First." in text and "Junk" not in text, (attrs, text)
    deep = f"<div class=overlay><div class=sidebar><p>Junk {body[:70]}</p></div><article>{inner}</article></div>"
    text = html_text.main_text(deep)
    assert "Second." in text and "Junk" not in text


def test_likenesses_against_the_exact_ones(spark):
    """near_edited and near_next stay close to the sum of minima over the sum of maxima."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    base, rows = [rng.choice(words) for _ in range(150)], []
    for n in range(120):
        base = [rng.choice(words) if rng.random() < n / 200 else w for w in base]
        rows.append((n, " ".join(base)))
    rows.append((120, ""))

    def exact(one, other):
        one, other = ({w: len(w) * t.split().count(w) for w in t.split()} for t in (one, other))
        both = [(one.get(w, 0), other.get(w, 0)) for w in {*one, *other}]
        return sum(map(min, both)) / sum(map(max, both)) if both else 1.0

    got = {r["doc_id"]: r for r in weighted_sketch.fingerprints(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    off = []
    for n, text in rows:
        after = rows[(n + 1) % len(rows)][1]
        edited = text[:len(text) - len(text) // 4] + after[:len(text) // 4]
        off += [got[n]["near_edited"] - exact(text, edited), got[n]["near_next"] - exact(text, after)]
    print(f"mean error {sum(off) / len(off):.4f}, root mean square {(sum(x * x for x in off) / len(off)) ** 0.5:.4f}, "
          f"over 0.1: {sum(abs(x) > 0.1 for x in off)} of {len(off)}")
    assert max(map(abs, off)) < 0.15 and (sum(x * x for x in off) / len(off)) ** 0.5 < 0.04
    assert sum(abs(x) > 0.1 for x in off) <= 0.01 * len(off)


def test_darts_of_a_pair_do_not_grow_with_its_words(spark):
    """One draw for each word and sample would be 512,000 a row here."""
    text = " ".join(f"w{n:05d}" for n in range(2000))
    for repeats in (1, 4):
        long = " ".join(text.replace("w", chr(97 + n)) for n in range(repeats))
        pairs = spark.createDataFrame([(1, 5, long, long)], "k long, n long, one string, two string")
        thrown = weighted_sketch.darts(pairs, "k", "one", "two", ["n"])
        assert 2500 < thrown.where("a IS NOT NULL").count() < 3700
        got = weighted_sketch.sketch_pairs(pairs, "k", "one", "two", ["n"]).first()
        assert got["n"] == 5 and len(got["sketch_1"]) == 256 and got["sketch_1"] == got["sketch_2"]


def test_fingerprints_of_short_and_odd_texts(spark):
    """Of one word, of spaces, of one unit, of few units, and with repeated and null ids."""
    rows = [(None, "a"), (1, ""), (2, " \t "), (3, "a"), (4, "a"), (5, "aa aa a"), (5, "aa aa a"),
            (6, "word"), (7, None), (8, "a" * 9000 + " b")]
    got = weighted_sketch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and len(got[0]) == 7
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[1] == prints[2] == prints[7] == "" and prints[3] == prints[4] == prints[None]
    assert all(len(prints[n]) == 1024 for n in (3, 5, 6, 8)) and len({*prints.values()}) == 5
    near = {r["doc_id"]: (r["near_edited"], r["near_next"]) for r in got}
    assert near[1] == (1.0, 1.0) and near[3] == (1.0, 1.0) and near[2][1] == 0.0 and near[6][1] == 0.0
    assert near[8][1] < 0.05 and all(0 <= x <= 1 for n in near.values() for x in n)


def test_contaminated_rows_go_whatever_the_columns_are_called(spark):
    names = ("hits", "__hits", "__row", "__text", "__whole", "items", "spans", "n_hit", "n_words", "row")
    item = " ".join(f"b{n}" for n in range(12))
    docs = spark.createDataFrame([(1, "x " + item), (2, "clean"), (2, "clean"), (3, None), (4, "")],
                                 "doc_id long, text string").withColumns(
        {c: F.lit(c) for c in names})
    benchmark = spark.createDataFrame([(7, item), (8, None)], "item_id long, text string")
    kept = decontaminate.without_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert listed(kept, *docs.columns) == listed(docs.where("doc_id > 1"), *docs.columns)
    assert decontaminate.without_contaminated(docs.limit(0), benchmark).collect() == []


def test_contexts_of_many_texts_are_those_of_each(spark):
    rng = random.Random(5)
    texts = [b"", b" \n", b"a", b"b " * 40, *[
        b" ".join(rng.choice([b"u", b"v", b"w", "é".encode()]) for _ in range(n)) for n in (12, 13, 14, 0, 90)],
        b"c" * 800, b"a b " * 300, b""]
    for rule in word_passages.rule(), byte_passages.rule():
        def contexts(some):
            edges = np.concatenate([[0], np.cumsum([len(t) for t in some])])
            symbols, counts = rule.symbols(np.frombuffer(b"".join(some), np.uint8), edges)
            assert counts.tolist() == [len(rule.units(t)) for t in some]
            return [x.tolist() for x in passages._contexts(
                symbols, np.concatenate([[0], np.cumsum(counts)]), rule.window, rule.gram)]

        alone = [contexts([t]) for t in texts]
        assert contexts(texts) == [
            [at for at, found in enumerate(alone) for _ in found[0]],
            *[[x for found in alone for x in found[i]] for i in range(1, 6)]]
        assert sum(len(found[0]) for found in alone) > 3


def test_tables_of_repeated_passages_take_less_room_than_the_texts(spark):
    """Checkpoints of anchors took several times the size of the texts."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(20_000)]
    passage = " ".join(rng.choices(words, k=1500))
    rows = [(i, f"{' '.join(rng.choices(words, k=20))} n{i} {passage} {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = shared_folder(spark).removeprefix("file:")

    def room():
        return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(folder) for name in names)

    before = room()
    got = {r["doc_id"]: r["n_removed"] for r in word_passages.report(docs).collect()}
    assert room() - before < sum(len(t) for _, t in rows)
    assert got == {i: 1500 if i else 0 for i, _ in rows}
