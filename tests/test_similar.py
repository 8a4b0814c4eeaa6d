import hashlib
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.functions import shingles
from kindred.operators import copies, hamming, sequence, star, timeline
from kindred.plans import registry, scan


def greedy(order, near):
    done, out = set(), {}
    for v in order:
        if v not in done and near.get(v):
            out[v] = set(near[v])
            done |= {v, *near[v]}
    return out


@pytest.mark.parametrize("small", [0, 50_000])
def test_star_groups_follow_the_sequential_rule(spark, monkeypatch, small):
    monkeypatch.setattr(star, "SMALL", small)
    rng = random.Random(3)
    n = 40
    pairs = {(a, b) for a in range(n) for b in range(a) if rng.random() < 0.06}
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    size = {v: rng.randrange(5) for v in range(n)}
    want = greedy(sorted(range(n), key=lambda v: (-size[v], v)), near)
    items = spark.createDataFrame(list(size.items()), "id long, size long")
    edges = spark.createDataFrame([(a, b, 1.0) for x in pairs for a, b in (x, x[::-1])], "a long, b long, similarity double")
    got = {}
    for r in star.star_groups(items, edges).collect():
        got.setdefault(r["anchor"], set()).add(r["member"])
    assert got == want


def test_a_star_isn_t_transitive(spark):
    e = [(0, 1), (1, 0), (1, 2), (2, 1)]
    edges = spark.createDataFrame([(a, b, 0.6) for a, b in e], "a long, b long, similarity double")
    largest = lambda v: spark.createDataFrame([(i, 9 if i == v else 1) for i in range(3)], "id long, size long")
    got = lambda v: {(r["anchor"], r["member"]) for r in star.star_groups(largest(v), edges).collect()}
    assert got(1) == {(1, 0), (1, 2)}
    assert got(0) == {(0, 1), (2, 1)}


@pytest.mark.parametrize("threshold", [0.8, 0.5, 0.0])
def test_hamming_pairs_are_all_pairs(spark, threshold):
    rng = random.Random(1)
    hs = [rng.getrandbits(64) for _ in range(40)]
    hs += [h ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for h in hs[:20]]
    rows = [(i, [h >> 16 * k & 65535 for k in range(4)]) for i, h in enumerate(hs)]
    d = spark.createDataFrame(rows, "id long, h array<long>")
    want = {(i, j) for j in range(len(hs)) for i in range(j) if max(0.0, 1 - 2 * (hs[i] ^ hs[j]).bit_count() / 64) >= threshold}
    got = [(r["a"], r["b"]) for r in hamming.pairs(d, d, threshold, same=True).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_hashes_are_counted_and_ranked_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(hamming, "HASH_BLOCK_ROWS", 50)
    monkeypatch.setattr(hamming, "CELLS", 300)
    monkeypatch.setattr(hamming, "pairs", None)  # no pair becomes a row
    rng = random.Random(5)
    hs = [rng.getrandbits(64) & 0xFFFF0000FF0000FF for _ in range(300)]
    d = spark.createDataFrame([(i, [h >> 16 * k & 65535 for k in range(4)]) for i, h in enumerate(hs)] + [(1000, None)], "id long, h array<long>")
    apart = [(i, j, (hs[i] ^ hs[j]).bit_count()) for i in range(300) for j in range(300) if i != j]
    want = {}
    for i, j, n in apart:
        if i < j:
            want[n] = want.get(n, 0) + 1
    assert {r["distance"]: r["n"] for r in hamming.histogram(d).collect()} == want
    got = sorted((r["a"], r["rank"], r["b"], r["distance"]) for r in hamming.nearest(d.filter("id % 7 = 0"), d, 4).collect())
    assert got == [(i, k + 1, j, n) for i in range(0, 300, 7) for k, (n, j) in enumerate(sorted((n, j) for x, j, n in apart if x == i)[:4])]


def seqs(spark, rows):
    return spark.createDataFrame(rows, "id long, items array<long>")


def test_sequences(spark):
    rng = random.Random(2)
    whole = [rng.getrandbits(32) for _ in range(500)]
    noisy = [v ^ (1 << rng.randrange(32)) if rng.random() < 0.3 else v for v in whole]
    other = [rng.getrandbits(32) for _ in range(500)]
    half = whole[250:] + other[:250]
    d = seqs(spark, [(0, whole), (1, noisy), (2, whole[200:320]), (3, [rng.getrandbits(32) for _ in range(500)]), (4, half)])
    got = {(r["q"], r["v"]): r["similarity"] for r in sequence.similarities(d, d).collect()}
    assert got[0, 0] == 1.0 and got[0, 1] > 0.9 and got[0, 2] == got[2, 0] == 1.0
    assert got.get((0, 3), 0.0) < 0.2 and 0.35 < got[0, 4] < 0.65


def share_by_definition(a, b, met):
    """Every window of offsets that ends at a match, every frame by itself."""
    if (a[-1] - a[0], len(a)) > (b[-1] - b[0], len(b)):
        a, b, met = b, a, [(j, i) for i, j in met]
    moves = sorted((b[j] - a[i], i) for i, j in met)
    windows = [[m for m in moves[: k + 1] if m[0] >= end - 6.0] for k, (end, _) in enumerate(moves)]
    best = max(windows, key=lambda w: len({i for _, i in w}), default=[])
    agree = {i for _, i in best}
    if len(agree) < min(3, len(a)):
        return 0.0
    move = best[len(best) // 2][0]
    against = 0
    for i, t in enumerate(a):
        if i not in agree:
            hidden = min(abs(t - a[k]) for k in agree) <= 30.0 and b[0] - 0.25 <= t + move <= b[-1] + 0.25 and not any(abs(x - t - move) <= 0.25 for x in b)
            against += not hidden
    return len(agree) / (len(agree) + against)


def test_timelines_against_all_pairs_of_frames(spark):
    rng = random.Random(7)
    pool = [rng.getrandbits(64) for _ in range(30)]
    lines = {}
    for v in range(8):
        lines[v] = [(float(2 * k + v), (rng.choice(pool) if rng.random() < 0.5 else rng.getrandbits(64)) ^ (1 << rng.randrange(64) if rng.random() < 0.3 else 0)) for k in range(40)]
    lines[8] = [(t + 11.0, h) for t, h in lines[0][5:30]]
    rows = [(v, i, t, [h >> 16 * k & 65535 for k in range(4)]) for v, fs in lines.items() for i, (t, h) in enumerate(fs)]
    d = spark.createDataFrame(rows, "id long, i long, t double, h array<long>")
    share = lambda a, b: any((a >> 16 * k & 65535) == (b >> 16 * k & 65535) for k in range(4)) and (a ^ b).bit_count() <= 10
    got = {(r["a"], r["b"]): r["similarity"] for r in timeline.similarities(d, d).collect()}
    for a in lines:
        for b in lines:
            if a != b:
                met = [(i, j) for i, (_, x) in enumerate(lines[a]) for j, (_, y) in enumerate(lines[b]) if share(x, y)]
                want = share_by_definition([t for t, _ in lines[a]], [t for t, _ in lines[b]], met)
                assert got.get((a, b), 0.0) == pytest.approx(want)
    assert got[0, 8] > 0.9


def fake(folder, name, text):
    import os

    p = folder / name
    p.write_text("#!/bin/sh\n" + text)
    p.chmod(0o755)
    os.environ["PATH"] = f"{folder}{os.pathsep}{os.environ['PATH']}"


def test_what_programs_say_becomes_features(tmp_path, monkeypatch):
    import struct

    import numpy as np

    from kindred.plans import external

    monkeypatch.setenv("PATH", __import__("os").environ["PATH"])
    fake(tmp_path, "fpcalc", """case "$5" in bad) echo no >&2; exit 3;; short) echo '{"duration": 1, "fingerprint": []}';; *) echo '{"duration": 2.5, "fingerprint": [1, -1, 4294967295]}';; esac""")
    got = external.Audio().extract("x")
    assert external.Audio.HEADER.unpack_from(got) == (2.5, 3) and struct.unpack_from("<3I", got, 12) == (1, 2**32 - 1, 2**32 - 1)
    for path, why in (("bad", "no"), ("short", "too short")):
        with pytest.raises(registry.ExtractionFailed, match=why):
            external.Audio().extract(path)
    rng = np.random.default_rng(1)
    frames = rng.integers(0, 256, (7, 8, 9)).astype(np.uint8)
    frames[2], frames[4] = frames[1], 7  # a repeat, and a flat one
    (tmp_path / "frames").write_bytes(frames.tobytes())
    times = ["0.5", "1.5", "2.5", "N/A", "4.5", "5.5", "6.5"]
    said = "\n".join(["  Duration: 00:01:02.50, start: 0.250000, bitrate: 1", *(f"[Parsed_showinfo_3 @ 0x1] n:0 pts: 1 pts_time:{t} duration" for t in times)])
    (tmp_path / "said").write_text(said)
    fake(tmp_path, "ffmpeg", f"cat {tmp_path}/said >&2; cat {tmp_path}/frames")
    assert external.Video.check_programs() is None
    got = external.Video().extract("x")
    assert external.Video.HEADER.unpack_from(got) == (0.25, 62.75, 4)
    kept = np.frombuffer(got, external.Video.FRAME, offset=external.Video.HEADER.size)
    assert kept["t"].tolist() == [0.5, 1.5, 5.5, 6.5]
    fake(tmp_path, "ffmpeg", "echo ffmpeg version 4.4.1 Copyright")
    assert "found 4.4" in external.Video.check_programs()
    for k, i in enumerate((0, 1, 5, 6)):
        bits = "".join("1" if frames[i, r, c + 1] > frames[i, r, c] else "0" for r in range(8) for c in range(8))
        assert int(kept["h"][k]) == int(bits, 2)


def test_repeated_frames_compare_with_the_last_kept(spark):
    d = spark.createDataFrame([(1, i, float(i), [h, 0, 0, 0]) for i, h in enumerate([0, 1, 3, 7, 15, 31])], "id long, i long, t double, h array<long>")
    assert sorted(r["i"] for r in timeline.drop_repeats(d).collect()) == [0, 4]


@registry.register
class Number(registry.Extractor):
    name, version, default_threshold = "number", 1, 0.5
    default_params = {"scale": 10}

    def extract(self, data):
        if data == b"bad":
            raise registry.ExtractionFailed("no number")
        return data

    def similarity(self, a, b):
        return max(0.0, 1 - abs(int(a) - int(b)) / self.params["scale"])


def number_items(spark, rows):
    return spark.createDataFrame([(u, s, str(v).encode()) for u, s, v in rows], "uri string, size long, content binary").withColumns({"mtime_ns": F.lit(1).cast("long"), "validator": F.lit(None).cast("string"), "is_remote": F.lit(False)})


def found(df):
    out = {}
    for r in df.filter("role = 'member'").collect():
        out.setdefault(r["anchor"], {})[r["uri"]] = round(r["similarity"], 4)
    return out


def test_own_extractor(spark):
    d = number_items(spark, [("a", 9, 0), ("b", 1, 3), ("c", 1, 1), ("d", 1, "bad")])
    r = scan.find_similar(d, "number")
    assert found(r.groups) == {"a": {"b": 0.7, "c": 0.9}}
    assert [x["uri"] for x in r.unreadable.collect()] == ["d"]
    fs = scan.extract_features(d, "number")
    assert found(scan.group_features(fs, 0.85)) == {"a": {"c": 0.9}}
    with pytest.raises(ValueError):
        scan.group_features(fs, 1.5)


def test_references_keep_all_their_neighbours(spark):
    d = number_items(spark, [("a", 1, 0), ("b", 1, 1), ("c", 1, 9)])
    refs = number_items(spark, [("r1", 1, 0), ("r2", 1, 9)])
    assert found(scan.find_similar(d, "number", references=refs).groups) == {"r1": {"a": 1.0, "b": 0.9}, "r2": {"c": 1.0}}


def test_registry():
    with pytest.raises(ValueError):
        registry.get_extractor("number", nothing=1)
    assert registry.get_extractor("number", scale="20").params == {"scale": 20}
    with pytest.raises(KeyError):
        registry.get_extractor("none")
    with pytest.raises(TypeError):
        registry.register(object)


def test_sequences_needn_t_meet_themselves(spark):
    rng = random.Random(9)
    whole = [rng.getrandbits(32) for _ in range(300)]
    d = seqs(spark, [(0, whole), (1, whole[50:250]), (2, [rng.getrandbits(32) for _ in range(300)])])
    got, every = ({(r["q"], r["v"]): r["similarity"] for r in sequence.similarities(d, d, others=o).collect()} for o in (True, False))
    assert got == {k: x for k, x in every.items() if k[0] != k[1]} and set(got) == {(0, 1), (1, 0)}


def test_matches_are_added_up_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(timeline, "FRAME_BLOCK", 40)
    monkeypatch.setattr(timeline, "MATCHES", 16)
    monkeypatch.setattr(timeline, "match_pairs", None)  # no match becomes a row
    rng = random.Random(8)
    hs = [rng.getrandbits(64) for _ in range(6)]
    rows = [(u, i, float(rng.randrange(20)), rng.choice(hs) ^ (1 << rng.randrange(64))) for u in range(12) for i in range(10)]
    d = spark.createDataFrame([(u, i, t, [h >> 16 * k & 65535 for k in range(4)]) for u, i, t, h in rows], "id long, i long, t double, h array<long>")
    counts, met = {}, {}
    for a, i, ta, x in rows:
        for b, _, tb, y in rows:
            if a != b and (x ^ y).bit_count() <= 10 and any((x ^ y) >> 16 * k & 65535 == 0 for k in range(4)):
                n, s = counts.get((a, b), (0, 0))
                counts[a, b] = n + 1, s + (x ^ y).bit_count()
                met.setdefault((a, b), []).append((tb - ta, i))
    assert sorted((r["a"], r["b"], r["n"], r["distance"]) for r in timeline.match_counts(d).collect()) == sorted((*k, *v) for k, v in counts.items())
    want = [(*k, max(len({i for e, i in v if at - 6 <= e <= at}) for at, _ in v)) for k, v in met.items()]
    assert sorted((r["a"], r["b"], r["matched"]) for r in timeline.best_windows(d).collect()) == sorted(want)


def test_values_of_many_sequences_count(spark, monkeypatch):
    monkeypatch.setattr(copies, "BLOCK", 40)
    rng = random.Random(11)
    base, key = [rng.getrandbits(32) for _ in range(60)], lambda v: v * 0x9E3779B1 % 2**32 < 1 << 30
    rows = [base[:k] + [rng.getrandbits(32)] + base[k + 1 :] for k in range(60)]  # the values of base are in more than 50 sequences
    rows += [rows[3], rows[3], base[10:40], base[30:] + [rng.getrandbits(32) for _ in range(30)], [], None]
    one = next(v for v in iter(lambda: rng.getrandbits(32), None) if key(v))
    dull = [v for v in (rng.getrandbits(32) for _ in range(60)) if not key(v)]
    rows += [dull[:9] + [one], dull[:9] + [one], dull[:8] + [one, one], dull[:9] + [one]]  # copies with one indexed item don't find each other
    for _ in range(20):
        whole = [rng.getrandbits(32) for _ in range(rng.randrange(1, 90))]
        rows += [whole, whole[rng.randrange(9) :], [v ^ (rng.random() < 0.3) << rng.randrange(32) for v in whole]]
    d = seqs(spark, list(enumerate(rows)))
    e = sequence.similarities(d, d, limit=10**9, threshold=0.7, others=True)
    sizes = spark.createDataFrame([(i, len(v or [])) for i, v in enumerate(rows)], "id long, size long")
    of = lambda g: sorted((r["anchor"], r["member"], round(r["similarity"], 9)) for r in g.collect())
    want = of(star.star_groups(sizes, e.select(F.col("q").alias("a"), F.col("v").alias("b"), "similarity")))
    raw = spark.createDataFrame([(i, None if v is None else struct.pack(f"<{len(v)}I", *v)) for i, v in enumerate(rows)], "id long, items binary")
    assert of(copies.groups(raw, len(rows), 0.7)) == want
    assert sum(b < 62 and a < 62 for a, b, _ in want) == 61


def test_links_don_t_depend_on_how_much_is_compared_at_once(monkeypatch):
    rng = random.Random(12)
    lines = [[rng.getrandbits(32) for _ in range(80)] for _ in range(6)]
    rows = sorted({struct.pack(f"<{len(v)}I", *v) for x in lines for v in (x, x[5:], x[:70], x[20:] + x[:20], x[:30] * 2)})
    b = copies.Block(pa.table({"id": pa.array(range(len(rows))), "items": pa.array(rows, pa.large_binary())}))
    of = lambda same: sorted((int(x), int(y), float(s)) for t in copies.links(b, b, same, 0.5) for x, y, s in zip(*t))
    want = of(True)
    monkeypatch.setattr(copies, "AT_ONCE", 7)
    monkeypatch.setattr(copies, "CELLS", 40)
    assert of(True) == want and len(want) > 40 and len(set(want)) == len(want)


def test_runs_of_words_are_hashed_as_md5_has_it():
    texts = ["a b", "a b c", " a\tb\x0b c\r\nd " + "\u00fc" * 30 + " x", "\u00e9" * 60 + " b c\u00a0d e", None, "", "x " * 40]
    for text, got in zip(texts, shingles.sequences([t and t.encode() for t in texts])):
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        want = [int(hashlib.md5(" ".join(ws[i : i + 3]).encode()).hexdigest()[:8], 16) for i in range(len(ws) - 2)]
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == want


def test_pairs_with_one_match_need_no_windows():
    for cells in (10, 1 << 40):  # few of very many pairs take no room for all of them
        assert timeline.alone(np.array([3, 5, 3, 9, 0]), cells).tolist() == [False, True, False, True, True]
    assert timeline.alone(np.zeros(0, np.int64), 0).tolist() == []
