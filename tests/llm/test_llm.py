"""The training-data operators against brute force on small inputs with nulls, empty, long and repeated rows."""

import collections
import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from spanforge.llm import ann, bwt, chunks, decontam, lines, mixing, quality, rans, simhash, suffix, tokens
from spanforge.llm.graph import components, forest
from spanforge.llm.licenses import MIT, license_scan
from spanforge.llm.spans import merged

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASH = ["size", "u", "row", "score", "key", "t1", "t2", "ranges", "fp", "id", "line", "kept", "n_words"]
RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randrange(2, 9))) for _ in range(300)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def rows():
    shared = prose(120, 99)
    long = prose(6000, 5)
    texts = [prose(200, k) for k in range(8)]
    texts += [texts[0], texts[0], prose(30, 20) + " " + shared + " " + prose(30, 21), prose(25, 22) + " " + shared, long, long[: len(long) // 2] + " changed " + long[len(long) // 2 :]]
    texts += ["", None, " \t\n ", "word", "Ünï çödé ¡ñ! 日本語", "a" * 3000, "ab " * 900, prose(80, 30) + "\n" + prose(40, 31) + "\n" + prose(40, 31) + "\n\n" + prose(80, 32)]
    out = [(100 - k, t, "en", ("x", "y", "z", None)[k % 4], 0) for k, t in enumerate(texts)]
    return [*out, out[3], (None, prose(50, 40), None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_rans_round_trip():
    for n, top in ((0, 1), (1, 1), (63, 5), (64, 50000), (70001, 50000), (70001, 2)):
        ids = np.random.default_rng(n).integers(0, top, n).astype("<u2")
        docs_, sizes, got = rans.unpack(rans.pack(ids, [None, 3], np.array([n, 0])))
        assert docs_ == [None, 3] and sizes.tolist() == [n, 0] and (got == ids).all()
    data = bytearray(rans.pack(np.arange(5000, dtype="<u2"), [1], np.array([5000])))
    data[-1] ^= 1
    with pytest.raises(ValueError):
        rans.unpack(bytes(data))


def test_tokens(docs, clashing, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.vocabulary())
    got = sorted(tokens.token_digests(clashing).collect(), key=lambda r: r.start)
    want = collections.Counter((i, len(e) + 1, zlib.crc32(np.array([*e, 0], "<u4").tobytes())) for i, t, *_ in rows() for e in [tok.encode(t or "", add_special_tokens=False).ids])
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x or 0))
    assert tokens.token_digests(empty).count() == 0


def encoded(coder, texts):
    ids, sizes = coder.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if texts else []


PARTS = ["a", "b'll", " ", "  ", "\n", "\n\n", "\t", "\r\n", " \n", "é", "²", "12", "!!", "\xa0", " x", "<|endoftext|>", "<|endof", "text|>", "word,\nNext", "日本", "\x1c", "\0", "İ", "'s", "'", "’", "—", "Ñandú", "q"]


@pytest.mark.parametrize("parts", [PARTS, [p for p in PARTS if tokens.COMMON.fullmatch(p) and "|" not in p], ["a", " b", "Ñandú", "12", "!!", "\n", " ", "²", "«", "—"]])
def test_pieces_match_whole_texts(parts):
    from tokenizers import Tokenizer

    tok, coder, rng = Tokenizer.from_file(tokens.vocabulary()), tokens.Pieces(tokens.vocabulary()), random.Random(3)
    assert encoded(coder, []) == []
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)]
    for k in range(0, len(texts), 100):
        for t, got in zip(texts[k : k + 100], encoded(coder, texts[k : k + 100]), strict=True):
            assert got == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_added_tokens_get_their_ids(spark):
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(tokens.vocabulary()), random.Random(5)
    assert tok.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(12))) for _ in range(600)] + ["a <|endoftext|> b", "<|endoftext|>"]
    got = {r.doc_id: r for r in tokens.token_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    start = 0
    for k, t in enumerate(texts):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs, clashing, empty):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(clashing).collect()}
    prints = [(i, brute_print(t)) for i, t, *_ in rows()]
    up = {k: k for k in range(len(prints))}
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                old, new = up[a], up[b]
                up = {k: new if v == old else v for k, v in up.items()}
    for k, (i, p) in enumerate(prints):
        ids = [prints[j][0] for j in up if up[j] == up[k] and prints[j][0] is not None]
        assert got[i, f"{p:016x}"] == (min(ids) if ids else None)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.deduplicated(clashing)
    assert kept.columns == clashing.columns
    own = kept.collect()
    assert {r.doc_id for r in own if r.doc_id is not None} == {v for v in got.values() if v is not None}
    assert len(own) == len({up[k] for k in up})  # one row of each component


def test_one_row_of_each_component_stays(spark):
    x, y, z, w = (prose(80, 3000 + k) for k in range(4))
    rows_ = [(3, x, "a"), (5, x, "b"), (5, y, "c"), (None, z, "d"), (None, z, "e"), (7, w, "f"), (7, w, "f"), (None, w, "g")]
    for seed in range(3):
        random.Random(seed).shuffle(rows_)
        got = simhash.deduplicated(spark.createDataFrame(rows_, "doc_id long, text string, t1 string").repartition(3)).collect()
        assert sorted(((r.doc_id or 0), r.text) for r in got) == sorted([(3, x), (5, y), (0, z), (7, w)])


def test_golay_keys_meet():
    rng = np.random.default_rng(1)
    assert len(np.unique(simhash._ERRORS)) == 2048
    for _ in range(300):
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        y = x
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            y ^= 1 << int(b)
        r, k = simhash.keys_of(np.array([x, y], np.uint64))
        assert set(k[r == 0]) & set(k[r == 1])


def test_large_keys_are_dealt_by_blocks(spark, monkeypatch):
    base = int(np.random.default_rng(0).integers(0, 1 << 62))
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)} | {base})
    df = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(2)
    monkeypatch.setattr(simhash, "MOST", 20)
    got = components(simhash.link_fingerprints(df))
    assert {r.root for r in got.collect()} == {fps[0]} and got.count() == len(fps) - 1


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)] + [(5, 5)]
    want = dict(forest(edges))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_dedup(docs, clashing, empty, monkeypatch):
    texts = [(t or "").encode() for _, t, *_ in rows()]
    n = suffix.LENGTH
    count = collections.Counter(b[k : k + n] for b in texts for k in range(len(b) - n + 1))
    want = collections.Counter()
    for (i, *_), b in zip(rows(), texts, strict=True):
        at = np.array([k for k in range(len(b) - n + 1) if count[b[k : k + n]] > 1], np.int64)
        runs = merged(np.stack([at, at + n], 1))
        kept, p = b"", 0
        for a, z in runs.tolist():
            kept, p = kept + b[p:a], z
        kept += b[p:]
        want[i, len(b), len(b) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()] += 1
    for heavy in (suffix.HEAVY, 500):
        monkeypatch.setattr(suffix, "HEAVY", heavy)
        got = suffix.without_repeats(clashing, digests_only=True)
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want
    assert suffix.without_repeats(empty).count() == 0


def test_interval_expansion():
    rng = random.Random(1)
    for _ in range(150):
        least = rng.choice([3, 5, 8, 20])
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 8))]
        parts.append(parts[0] + b"c" + parts[-1])
        c = collections.Counter(s[i : i + least] for s in parts for i in range(len(s) - least + 1))
        for s, got in zip(parts, bwt.repeated_starts(parts, least), strict=True):
            assert got.tolist() == [i for i in range(len(s) - least + 1) if c[s[i : i + least]] > 1]


def test_chunk_dedup(docs, clashing, empty):
    by_key = sorted({(i is not None, i or 0, t or "") for i, t, *_ in rows()}, key=lambda x: x[:2])
    for least in (chunks.LEAST_RUN, 0):
        seen, want = set(), {}
        for known, i, t in by_key:
            b, at, gone = t.encode(), 0, []
            for end in chunks.cuts(b):
                if b[at:end] not in seen:
                    seen.add(b[at:end])
                elif gone and gone[-1][1] == at:
                    gone[-1][1] = end
                else:
                    gone.append([at, end])
                at = end
            gone = [g for g in gone if g[1] - g[0] >= least or g[1] - g[0] == len(b)]
            kept = b"".join(b[x:y] for x, y in zip([0, *(g[1] for g in gone)], [*(g[0] for g in gone), len(b)], strict=True))
            want[i if known else None, len(b)] = (len(b) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
        got = chunks.deduplicated_text(clashing, least).collect()
        assert len(got) == len(rows())
        for r in got:
            assert want[r.doc_id, r.n_bytes] == (r.n_removed, r.n_spans, r.kept_sha256)
            assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256
    assert chunks.deduplicated_text(empty).count() == 0
    data = prose(3000, 77).encode()
    a, b = ({x[p:q] for p, q in zip([0, *chunks.cuts(x)], chunks.cuts(x), strict=False)} for x in (data, data[:500] + b"inserted" + data[500:]))
    assert len(a - b) <= 4


def test_passages_of_fifty_words_go_and_shared_half_sentences_stay(spark):
    rng = random.Random(31)
    caught, left = 0, 0
    texts = []
    for k in range(100):
        passage, half = prose(51, 5000 + k), prose(8, 6000 + k)
        for side in range(2):
            texts.append((k * 2 + side, prose(rng.randrange(40, 90), 7000 + k * 2 + side) + " " + passage + " " + prose(60, 8000 + k * 2 + side)))
            texts.append((1000 + k * 2 + side, prose(60, 9000 + k * 2 + side) + " " + half + " " + prose(60, 9500 + k * 2 + side)))
    got = {r.doc_id: r.n_removed for r in chunks.deduplicated_text(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    caught, left = sum(got[k * 2 + 1] > 0 for k in range(100)), sum(got[1000 + k * 2 + 1] == 0 for k in range(100))
    assert caught >= 93 and left >= 97, (caught, left)


def test_line_dedup(spark, clashing, empty, monkeypatch):
    base = [prose(30, k) for k in range(6)]
    near = [base[0] + "x", base[0][:-1] + "yz", "q" + base[1]]
    texts = [(k, "\n".join(random.Random(k).sample(base + near, 5)) + "\n \nab\nab") for k in range(12)] + [(50, None), (51, ""), (3, "\n".join(base[:2]))]
    first = {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        for no, x in enumerate((t or "").split("\n")):
            if x.strip(" "):
                first.setdefault(x, []).append((i, no))
    different = list(first)
    sets = [lines.shingles(x) for x in different]
    got_links = dict(forest((a, b) for a in range(len(sets)) for b in range(a) if lines.similar(sets[a], sets[b])))
    classes = collections.defaultdict(list)
    for k, x in enumerate(different):
        classes[got_links.get(k, k)] += first[x]
    gone = collections.Counter(i for places in classes.values() for i, _ in sorted(places)[1:])
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for few, most in ((lines.FEW, lines.MOST), (1, 2)):
        monkeypatch.setattr(lines, "FEW", few)
        monkeypatch.setattr(lines, "MOST", most)
        got = collections.Counter()
        for r in lines.line_report(df).collect():
            got[r.doc_id] += r.n_removed
        assert +got == +gone
    kept = {r.doc_id: r.text for r in lines.deduplicated_lines(df).collect() if r.doc_id != 3}
    assert kept[51] == "" and kept[50] == "" and sum(len([x for x in t.split("\n") if x.strip()]) for t in kept.values()) <= len(classes)
    assert lines.line_report(clashing).count() == len(rows())
    assert lines.line_report(empty).count() == 0


def test_decontamination(spark, docs, clashing, empty):
    items = [(1, prose(40, 500)), (2, prose(15, 501)), (3, "tiny one"), (4, None), (5, ""), (6, prose(12, 502))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    noisy = list(items[0][1].upper())
    for k in range(10, len(noisy), 25):
        noisy[k] = "#"
    bad = [(1000, prose(50, 600) + "\n" + items[0][1] + " " + prose(20, 601)), (1001, "".join(noisy) + prose(60, 602)), (1002, "Tiny, ONE"), (1003, prose(9, 603) + "; " + items[1][1].replace(" ", "  "))]
    clean = [(1004, items[1][1][: len(items[1][1]) // 3]), (1005, "tinyone"), (1006, None)]
    df = spark.createDataFrame([(i, t, "en", "x", 0) for i, t in bad + clean], DOC).unionByName(docs)
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()} == {(1000, 1), (1001, 1), (1002, 3), (1003, 2)}
    assert {i for i, *_ in rows()} | {1004, 1005, 1006} == {r.doc_id for r in decontam.decontaminated(df, bench).select("doc_id").collect()}
    assert decontam.decontaminated(clashing, bench).columns == clashing.columns
    assert decontam.leaks(empty, bench).count() == 0 and decontam.leaks(df, bench.limit(0)).count() == 0


def brute_distance(a, text):
    d = [0] * (len(text) + 1)
    for x in a:
        new = [d[0] + 1]
        for j, y in enumerate(text, 1):
            new.append(min(d[j - 1] + (x != y), d[j] + 1, new[-1] + 1))
        d = new
    return min(d)


def test_no_match_within_the_budget_is_lost():
    rng = random.Random(9)
    items = [(k, prose(rng.randrange(15, 45), 700 + k)) for k in range(12)]
    patterns = decontam.Patterns(items)
    for k in range(60):
        item, text = rng.choice(items)
        c = list(text)
        for _ in range(rng.randrange(0, 20)):
            p = rng.randrange(len(c))
            rng.choice([lambda: c.pop(p), lambda: c.insert(p, "z"), lambda: c.__setitem__(p, "q")])()
        doc = prose(30, k) + " " + "".join(c) + " " + prose(30, k + 1)
        codes = "".join(map(chr, decontam.normalised(doc)))
        want = {patterns.item[w] for w in range(len(patterns.item)) if brute_distance("".join(map(chr, patterns.codes[w])), codes) <= patterns.edits[w]}
        assert {i for _, i, _, _ in patterns.matches([doc])} == want


def test_mixing(spark, docs, clashing, empty):
    got = mixing.mixture(clashing).collect()
    sizes = collections.Counter()
    for _, t, _, s, _ in rows():
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left = {}, set(order)
    while True:
        level = (1.5 * sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in left)
        full = [s for s in left if level * weight[s] > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left.discard(s)
    target |= {s: level * weight[s] for s in left}
    most = max(r.size for r in got)
    for s in order:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= most
    again = mixing.mixture(docs.repartition(5)).collect()
    assert collections.Counter((r.doc_id, r.size, r.taken) for r in again) == collections.Counter((r.doc_id, r.size, r.taken) for r in got)
    mixed = mixing.mixed(clashing)
    assert mixed.columns == clashing.columns
    assert collections.Counter(r.doc_id for r in mixed.collect() if r.text and r.text.strip()) == collections.Counter({i: n for i, n in collections.Counter(r.doc_id for r in got for _ in range(r.taken // r.size if r.size else 0)).items()})
    assert mixing.mixture(empty).count() == 0


def test_quality(spark, clashing, empty):
    rng = random.Random(6)
    good = [(k, prose(rng.randrange(5, 200), k).capitalize() + ".") for k in range(400)]
    bad = [(k, re.sub(r"(\w+)", r"\1***", prose(rng.randrange(5, 200), k)) if k % 2 else " | ".join(prose(60, k).split())) for k in range(400, 700)]
    df = spark.createDataFrame([*good, *bad, (9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 400), 0) for k in range(700)] + [(None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(df, labels).collect()}
    assert len(got) == 702 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out and i < 700]
    assert sum(got[i].predicted == (i < 400) for i in held) >= 0.97 * len(held)
    model = quality.fit(df, labels)
    assert model.weights and quality.fit(df, labels.limit(0)).weights == ()
    assert quality.accepted(clashing, labels).columns == clashing.columns
    assert quality.quality_scores(empty, labels).count() == 0


def plain_statistics(text):
    """The twelve statistics, word by word and sign by sign."""
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    chars, n = max(1, len(text)), max(1, len(words))
    of = lambda signs: sum(c in signs for c in text) / chars
    power = np.log(len(set(words))) / np.log(len(words)) if len(words) > 1 else 1.0
    out = [len(words), len(text) / n, len(set(words)) / n, power, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n]
    out += [of("*$%&#@^~=<>{}\\_"), of("|"), of("!"), sum(unicodedata.category(c) == "Lu" for c in text) / chars, of("0123456789"), of(".,;:?"), of("\n")]
    return dict(zip(quality.statistics(), map(float, out), strict=True))


def test_quality_statistics_and_rule_sum(spark):
    texts = [None, "", " \t\n ", "one", "one one", "ONE Two! | {x}_y\n1234 | a.b,c;d:e?f", "Ünï ÇÉ ßẞ 日本 𝐀", "word " * 5000, "a" * 20000, "x\r\nx\x0bx\x0cx", "#$%^&*@~=<>\\", "\u00a0nbsp\u2003em"]
    texts += [prose(k, k) + "!" * (k % 3) + "\n" * (k % 5) for k in range(1, 40)]
    names = list(quality.statistics())
    clash = {c: F.lit("x") for c in (*names, "row", "score", "stats", "label", "rules", "quality", "predicted", "held_out")}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns(clash)
    got = {r.doc_id: r for r in df.select("doc_id", "text").select("doc_id", *(c.alias(n) for n, c in quality.statistics().items())).collect()}
    for k, t in enumerate(texts):
        for n, v in plain_statistics(t).items():
            assert abs(got[k][n] - v) <= 1e-12 * max(1, abs(v)), (k, n)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(len(texts))], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    assert model.weights
    scores = quality.quality_scores(df.unionByName(df.where("doc_id < 3")), labels).collect()
    assert sorted(r.doc_id for r in scores) == sorted([*range(len(texts)), 0, 1, 2]) and all(r.predicted == int(r.score >= 0.3) for r in scores)
    again = {r.row.doc_id: r.score for r in quality.scored(df, model).collect()}
    for k, t in enumerate(texts):
        s = plain_statistics(t)
        z = model.intercept + sum(w for rule, w in model.weights if all(s[n] <= at if sign == "<=" else s[n] > at for n, sign, at in rule.conditions))
        assert abs(again[k] - 1 / (1 + np.exp(-z))) < 1e-9, k


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 10))
    x[100:160] = x[50]
    data = [(k, [float(np.float32(v)) for v in row], 0) for k, row in enumerate(x)]
    data += [(700, None, 0), (750, [0.0] * 10, 0), (800, [1.0, None, *[0.0] * 8], 0), (850, [float("nan")] * 10, 0), (900, [float("inf"), *[1.0] * 9], 0), (950, [1.0, 2.0], 0), (None, [1.0] * 10, 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(4)
    got = collections.defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 50))
    f = np.array([d[1] for d in data[:600]])
    unit = f / np.linalg.norm(f, axis=1, keepdims=True)
    hits = 0
    for q, top in got.items():
        s = np.round(unit @ unit[q], 12)
        s[q] = -2
        want = np.lexsort((np.arange(600), -s))[:5]
        hits += len(set(want) & {v for _, v, _ in top})
        assert [r for r, _, _ in top] == [1, 2, 3, 4, 5]
        assert all(abs(sc - s[v]) < 1e-9 for _, v, sc in top)
        assert [(-sc, v) for _, v, sc in top] == sorted((-sc, v) for _, v, sc in top)
    assert hits >= 0.9 * 5 * len(got)
    assert [v for _, v, _ in got[100]] == [50, *range(101, 105)]
    few = ann.nearest(df.where("vec_id in (0, 1, 2)")).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert ann.nearest(df.limit(0)).count() == 0


def test_licences(spark, clashing, empty):
    texts = [(1, "Copyright (c) 2020 A. Person\n\n" + MIT.upper().replace(",", " ,")), (2, prose(10, 1) + "\nReleased under the MIT Licence\nsome"), (3, None), (4, "licensed under the apache license version 2.0"), (5, "MIT"), (1, "SPDX-License-Identifier: ISC"), (None, "MIT"), (None, "Released under the MIT License")]
    every = license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(r.licenses for r in every if r.doc_id == 1) == ["ISC", "MIT"] and sorted(r.licenses for r in every if r.doc_id is None) == ["", "MIT"]
    got = {r.doc_id: r for r in every}
    assert got[2].licenses == "MIT" and got[2].document_license is None
    assert got[3].licenses == "" and got[4].document_license == "Apache-2.0" and got[5].licenses == ""
    assert license_scan(clashing).count() == len(rows())
    assert license_scan(empty).count() == 0


def test_pipeline(spark):
    """Each stage against brute force on what the stage before really kept."""
    import corpus_pipeline
    from spanforge.llm.common import release, stage
    from tokenizers import Tokenizer

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    held = [[tuple(r) for r in docs.collect()]]
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, d))
        held.append([tuple(r) for r in docs.collect()])
        assert name == "tokens" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    first, fine, single, clean, mix, out = held
    scores = {r.doc_id: r.predicted for r in quality.quality_scores(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).collect()}
    assert sorted(map(str, fine)) == sorted(str(r) for r in first if scores[r[0]]) and 0 < len(fine) < len(first)
    prints = [(r[0], brute_print(r[1])) for r in fine]
    roots = dict(forest((a, b) for a in range(len(prints)) for b in range(a) if (prints[a][1] ^ prints[b][1]).bit_count() <= 4))
    groups = collections.defaultdict(list)
    for k, (i, _) in enumerate(prints):
        groups[roots.get(k, k)].append(i)
    assert sorted(r[0] for r in single) == sorted(min(g) for g in groups.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    patterns = decontam.Patterns(items)
    assert sorted(r[0] for r in clean) == sorted(r[0] for r in single if not patterns.matches([r[1] or ""]))
    whole = ["".join(map(chr, decontam.normalised(t))) for _, t in items if t]
    assert not [r[0] for r in clean for t in whole if len(t) > 40 and t in "".join(map(chr, decontam.normalised(r[1] or "")))]
    taken = {r.doc_id: r.taken // r.size if r.size else 0 for r in mixing.mixture(spark.createDataFrame(clean, DOC)).collect()}
    assert collections.Counter(r[0] for r in mix) == +collections.Counter(taken)
    tok, start = Tokenizer.from_file(tokens.vocabulary()), 0
    for (i, at, n, crc), r in zip(sorted(out, key=lambda x: x[1]), sorted(mix, key=lambda r: r[0]), strict=True):
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        assert (i, at, n, crc) == (r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).collect())) == sorted(out)
    release(spark)


def test_whole_licence_texts(spark):
    import textwrap

    from spanforge.llm.licenses import CORES, TEXTS, core_texts

    head = "Copyright (c) 2020 A. Person\n\n"
    bsd3 = next(t for i, t in core_texts() if i == "BSD-3-Clause")
    narrow = "\n".join(textwrap.fill(p, 62) for p in bsd3.split("\n"))
    assert "\ncopyright" in narrow.lower()
    cores = core_texts()
    texts = {"mit": "# Tool\n\n" + prose(20, 1) + "\n\n" + head + MIT + "\n\n" + prose(20, 2), "bsd3": "BSD 3-Clause License\n\n" + head + bsd3, "narrow": "/* " + narrow.replace("\n", "\n * ") + " */\n" + prose(9, 3), "wrapped": prose(9, 3) + "\n" + narrow, "cut": head + MIT[: len(MIT) // 2], "none": prose(30, 4)}
    texts |= {i: (TEXTS / f"{i}.txt").read_text() for i in CORES} | {f"core {k}": f"before {t} after" for k, (_, t) in enumerate(cores)}
    keys = list(texts)
    got = {keys[r.doc_id]: r for r in license_scan(spark.createDataFrame([(k, texts[x]) for k, x in enumerate(keys)], "doc_id long, text string")).collect()}
    assert (got["mit"].licenses, got["mit"].document_license) == ("MIT", None)
    assert (got["bsd3"].licenses, got["bsd3"].document_license) == ("BSD-3-Clause",) * 2
    assert got["narrow"].licenses == got["wrapped"].licenses == "BSD-3-Clause"
    assert got["cut"].licenses == got["none"].licenses == ""
    assert all((got[i].document_license, i in got[i].licenses.split(",")) == (i, True) for i in CORES)
    assert all(got[f"core {k}"].licenses == i for k, (i, _) in enumerate(cores))


def test_similar_pairs_match_sets():
    rng = random.Random(8)
    a, b = [], []
    for k in range(400):
        x = list(prose(rng.randrange(1, 60), k)[: rng.randrange(1, 400)])
        y = x[:]
        for _ in range(rng.randrange(0, 1 + len(x) // 60)):
            y[rng.randrange(len(y))] = "Z"
        a.append("".join(x))
        b.append("".join(y) + "é" * rng.randrange(3))
    got, want = lines.similar_pairs(a, b).tolist(), [lines.similar(lines.shingles(x), lines.shingles(y)) for x, y in zip(a, b, strict=True)]
    assert got == want and 50 < sum(want) < 350


def test_line_links_find_what_all_pairs_do(spark):
    """Recall of links at a similarity of 0.8 over all lines of a whole table."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    different = sorted({x for t in texts for x in t.split("\n") if x.strip(" ")})
    holders = collections.defaultdict(list)
    sets = [lines.shingles(x) for x in different]
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    pairs = []
    for k, s in enumerate(sets):
        both = collections.Counter(j for x in s for j in holders[x] if j < k)
        pairs += [(k, j) for j, n in both.items() if n >= lines.SIMILAR * (len(s) + len(sets[j]) - n)]
    roots = {different[k]: different[r] for k, r in forest(pairs)}
    df = spark.createDataFrame([(x,) for x in different], "line string").select("line", *lines._line_ids())
    got = {r.line: r.root for r in df.join(lines.linked_lines(df), ["id", "id2"]).collect()}
    linked = {x for p in pairs for x in (different[p[0]], different[p[1]])}
    assert len(linked) > 10 and set(got) <= linked and len(set(got)) >= 0.99 * len(linked)
    assert all(got.get(x) == got.get(r) for x, r in roots.items() if x in got)


def test_links_among_match_all_pairs():
    for seed in range(30):
        rng = random.Random(seed)
        some = []
        for k in range(rng.randrange(1, 25)):
            x = list(prose(40, rng.randrange(4))[: rng.randrange(1, 200)]) if k % 3 else list(rng.choice(some or ["ab"]))
            for _ in range(rng.randrange(0, 4)):
                x[rng.randrange(len(x))] = rng.choice("ZY")
            some.append("".join(x))
        sets = [lines.shingles(x) for x in some]
        want = dict(forest((i, j) for i in range(len(sets)) for j in range(i) if lines.similar(sets[i], sets[j])))
        got = lines.links_among(list(range(len(some))), some)
        assert dict(forest(got)) == want and len(got) == len(want)


def test_matches_are_those_of_each_text_alone():
    item = "quick brown fox"
    assert sorted(decontam.Patterns([(1, item)]).matches([item] * 3)) == [(t, 1, 1, 0) for t in range(3)]
    long = prose(40, 900)
    patterns = decontam.Patterns([(1, long), (2, item), (3, prose(9, 901)), (4, "ab cd"), (5, prose(4, 902))])
    half = len(long) // 2
    assert all(t not in (0, 1) for t, *_ in patterns.matches([long[: half // 2], long[half // 2 : half // 2 + 70], "x"]))
    rng = random.Random(4)
    texts = []
    for k in range(300):
        x = list(rng.choice([long, item, prose(9, 901), "ab cd", prose(4, 902), prose(5, k)]))
        for _ in range(rng.randrange(3)):
            x[rng.randrange(len(x))] = rng.choice("xyz ")
        x = "".join(x)
        texts.append(rng.choice([x, x[: rng.randrange(len(x))], prose(rng.randrange(1, 8), k) + " " + x, ""]))
    alone = {t: sorted(m[1:] for m in patterns.matches([t])) for t in texts}
    for size in (2, 7, 300):
        rng.shuffle(texts)
        for k in range(0, len(texts), size):
            got = collections.defaultdict(list)
            for t, *m in patterns.matches(texts[k : k + size]):
                got[t].append(tuple(m))
            assert [sorted(got[i]) for i in range(len(texts[k : k + size]))] == [alone[t] for t in texts[k : k + size]]


def test_short_items_within_their_edits_are_found():
    rng = random.Random(6)
    for size in range(10, 60):
        item = "a" + prose(30, size)[:size].strip() + "b"
        patterns = decontam.Patterns([(1, item)])
        edits = int(patterns.edits[0])
        for _ in range(5):
            c = list("".join(map(chr, decontam.normalised(item))))
            for p in rng.sample(range(len(c)), edits):
                c[p] = "q"
            assert [m[:2] for m in patterns.matches([prose(6, 7000 + size), prose(5, 1) + "".join(c) + prose(5, 2)])] == [(1, 1)]


def test_one_more_copy_comes_in_proportion_to_size(spark):
    rng = random.Random(12)
    sizes = [rng.randrange(1, 60) for _ in range(6000)] + [400] * 5
    df = spark.createDataFrame([(k, "w " * n, "a") for k, n in enumerate(sizes)], "doc_id long, text string, source string")
    got = mixing.mixture(df, share=0.5).collect()
    total = sum(sizes)
    c = 0.5 * total / sum(n * n for n in sizes)
    for _ in range(5):
        certain = sum(n for n in sizes if c * n >= 1)
        c = (0.5 * total - certain) / sum(n * n for n in sizes if c * n < 1)
    assert abs(sum(r.taken for r in got) - 0.5 * total) <= 60
    assert all(r.taken == r.size for r in got if c * r.size >= 1) and any(c * n >= 1 for n in sizes)
    for low, high in ((1, 15), (15, 30), (30, 45)):
        own = [r for r in got if low <= r.size < high]
        want = sum(min(1.0, c * r.size) for r in own)
        assert abs(sum(r.taken > 0 for r in own) - want) < 4.5 * want**0.5


def test_recall_over_a_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    own = sorted(ann.valid_vectors(df).collect(), key=lambda r: r.vec_id)
    ids, x = np.array([r.vec_id for r in own]), np.array([r.embedding for r in own], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = collections.defaultdict(set)
    for r in ann.nearest(df, every=4).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for i in np.flatnonzero(ids % 4 == 0):
        s = unit @ unit[i]
        s[i] = -2
        hits += len(got[int(ids[i])] & set(ids[np.argsort(-s)[:5]].tolist()))
    assert hits >= 0.93 * 5 * len(got) and len(got) == (ids % 4 == 0).sum()


def test_nearest_in_tight_clusters(spark):
    """Hundreds of vectors whose codes hardly differ: codes alone can't tell which are nearest."""
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(6, 16))[rng.integers(0, 6, 2400)] + 0.02 * rng.normal(size=(2400, 16))).astype(np.float32)
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r.rank): r.vec_id for r in ann.nearest(df).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for q in range(0, 2400, 50):
        s = unit @ unit[q]
        s[q] = -2
        assert [got[q, r] for r in range(1, 6)] == np.argsort(-s, kind="stable")[:5].tolist(), q


def test_nearest_with_clashing_columns_and_repeated_ids(spark):
    x = np.random.default_rng(4).normal(size=(120, 6)).astype(np.float32)
    data = [(k % 110, [float(v) for v in row], "x", "y", "z") for k, row in enumerate(x)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, block string, query string, list string")
    got = ann.nearest(df).collect()
    doubles = ann.nearest(df.withColumn("embedding", F.col("embedding").cast("array<double>"))).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(doubles)] == [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got)]
    assert sorted({r.query_id for r in got}) == [0, 50, 100] and all(r.vec_id != r.query_id for r in got)
    # vec_id 0 stands for two vectors, so it asks twice, and its other vector takes a place among those found
    assert collections.Counter(r.query_id for r in got)[50] == 5 and 8 <= collections.Counter(r.query_id for r in got)[0] <= 10


def test_blocks_of_lists():
    first, parts = ann.blocks_of(np.array([3, 4, 0, 30, 5, 5, 1]), 10)
    assert first.tolist() == [0, 0, 0, 1, 4, 4, 5] and parts.tolist() == [1, 1, 1, 3, 1, 1, 1]
