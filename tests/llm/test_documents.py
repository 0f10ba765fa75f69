"""Operators on documents against brute force, and with nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlink.llm import decontaminate, license, pii, quality, simhash, toxicity, urls
from kinlink.llm.common import no_clash

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "pe", "ra", "so", "ti", "vu") for b in ("da", "fo", "gi", "ha", "ju", "ke", "la", "me")]
CLASH = "doc_id long, text string, key string, t string, row string, mark string, fp string, word string"


def prose(r, n):
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f") for r in rows], CLASH)


ODD = [(9001, None), (9002, ""), (9003, " \n\t "), (None, "null id here"), (9004, "x" * 300_000), (9005, "same row twice"), (9005, "same row twice")]


# quality


def slow_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_against_brute_force():
    r = random.Random(3)
    texts = [None, "", "a a a a a a", "é ü\n\n b\n b\nb", "one two three four five", "a\x0bb\x0cc\x1cd\xa0e"]
    texts += ["".join(r.choice(["a ", "b ", "c\n", "#", "é "]) for _ in range(r.randrange(120))) for _ in range(300)]
    for t in texts:
        assert quality.statistics(t)[:5] == slow_statistics(t), t


def test_learned_rules_reject_junk_and_keep_clean(spark):
    r = random.Random(4)
    rows = [(i, prose(r, 40)) for i in range(200)] + [(1000 + i, " | ".join(prose(r, 40).split())) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in rows if i % 2] + [(1, None, 0), (None, 0, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    own = docs(spark, rows + ODD)
    rules = quality.fit(own, labels)
    kept = {x.doc_id for x in quality.keep_good(own, rules).collect()}
    assert kept == {i for i, _ in rows if i < 1000} and quality.keep_good(own, rules).columns == own.columns
    judged = {x.key: x for x in quality.judge(own, rules).collect()}
    assert {k for k, x in judged.items() if x.kept} == kept and judged[9001].base_failed and judged[9004].n_words == 1
    assert quality.fit(own.limit(0), labels) == [] and quality.fit(own, labels.limit(0)) == []
    assert quality.keep_good(own.limit(0), rules).count() == 0


# SimHash


def near(r, fp, most=4, lowest=0):
    for b in r.sample(range(lowest, 64), r.randrange(most + 1)):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("part_rows", [1 << 16, 40])
def test_links_and_components_against_brute_force(spark, part_rows):
    r = random.Random(part_rows)
    fps = {r.getrandbits(64) for _ in range(300)}
    for fp in list(fps)[:60]:
        fps.add(near(r, near(r, fp)))
    crowd = r.getrandbits(64)
    fps |= {near(r, crowd, 5) for _ in range(900)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = simhash.near_links(frame, part_rows=part_rows)
    assert edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 4).count() == 0
    got = {x.node: x.root for x in simhash.components(edges).collect()}
    u, forest = np.array(fps, np.uint64), simhash.Forest(len(fps))
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 4) + i + 1:
            forest.join(i, int(j))
    groups = defaultdict(list)
    for i, root in enumerate(forest.roots()):
        groups[root].append(signed[i])
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_dense_blocks_are_connected_by_pivots():
    r = random.Random(8)
    crowd = r.getrandbits(64)
    fp = np.unique(np.array([near(r, crowd, 6, lowest=26) for _ in range(1500)], np.uint64))
    edges = simhash.links(fp, 0, dense=64)
    forest, whole = simhash.Forest(len(fp)), simhash.Forest(len(fp))
    for a, b in edges:
        assert (int(fp[a]) ^ int(fp[b])).bit_count() <= 4
        forest.join(a, b)
    for a in range(len(fp)):
        for b in np.flatnonzero(np.bitwise_count(fp[a + 1 :] ^ fp[a]) <= 4) + a + 1:
            whole.join(a, int(b))
    assert len(edges) < len(fp) and (forest.roots() == whole.roots()).all()


def slow_simhash(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_frequent_shingles_are_counted_over_all_rows(spark):
    from xxhash import xxh64_intdigest

    known, held = simhash.Hashes(), " ".join(f"w{k}" for k in range(30))
    rows = [f"{i}a {i}b {i}c {i}d {i}e {i}f" for i in range(8000)]
    with_it = (f"{held} " + " ".join(f"u{i}x{k}" for k in range(40)) for i in range(1000))
    marked = [t for t in with_it if xxh64_intdigest(t.encode(), 42) % 2][:10]  # none is in a sample of the even hashes
    texts = spark.createDataFrame(list(enumerate(rows + marked * 20)), "doc_id long, text string").repartition(5)
    wanted = Counter(h for t in rows + marked * 20 for h in simhash.shingle_set(t, 5, known).view(np.int64).tolist())
    assert {r.h: r.n for r in simhash.frequent(texts.select("text"), 5, 20).collect()} == {h: n for h, n in wanted.items() if n >= 20}
    assert simhash.frequent(texts.limit(0).select("text"), 5, 1).count() == 0
    once = spark.createDataFrame(list(enumerate(rows + marked)), "doc_id long, text string")
    passage = set(simhash.shingle_set(held, 5, known).view(np.int64).tolist())
    keys = [set(r["keys"]) for r in simhash.similar_sets(once, key="doc_id", text="text", size=5, similarity=0.8).where("doc_id >= 8000").collect()]
    assert len(keys) == 10 and all(k and not k & passage for k in keys)


def test_near_duplicates(spark):
    r = random.Random(9)
    base = prose(r, 400)
    rows = [(i, prose(r, 80)) for i in range(40)] + [(50, base), (51, base.upper()), (52, base + " end"), *ODD]
    own = docs(spark, rows)
    found = {(x.doc_id, x.fp & (1 << 64) - 1): x.component_id for x in simhash.near_duplicates(own).collect()}
    assert set(found) == {(k, slow_simhash(t)) for k, t in rows}
    by = {k: c for (k, _), c in found.items()}
    assert (by[51], by[52], by[9002], by[9003], by[9005], by[None]) == (50, 50, 9001, 9001, 9005, None)
    stay = simhash.keep_one(own)
    assert sorted((x.doc_id for x in stay.collect()), key=str) == sorted([*range(40), 50, 9001, 9004, 9005, None], key=str)
    assert stay.columns == own.columns and simhash.keep_one(own.limit(0)).count() == 0


@pytest.mark.parametrize("part_rows", [1 << 16, 4])
def test_similar_texts_against_brute_force(spark, part_rows):
    r = random.Random(21)
    rows = [(i, prose(r, 60)) for i in range(20)]
    for k in range(20):
        words = rows[k][1].split()
        for j in range(3):
            edited = list(words)
            for at in r.sample(range(60), 1 + j % 2):
                edited[at] = f"edit{k}x{j}"
            rows.append((100 + 10 * k + j, " ".join(edited)))
        rows.append((100 + 10 * k + 5, " ".join(words[30:] + words[:30])))
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in ((k, t.lower().split()) for k, t in rows)}
    up = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    up[a] = up[b] = min(up[a], up[b])
        if all(up[up[k]] == up[k] for k in up):
            break
    found = simhash.near_duplicates(docs(spark, rows), size=5, similarity=0.8, part_rows=part_rows).collect()
    assert {x.doc_id: x.component_id for x in found} == up and 20 < len(set(up.values())) < 80


# decontamination


def test_leaks_against_brute_force(spark):
    r = random.Random(11)
    items = [(i, prose(r, r.choice([5, 7, 20, 46, 59]))) for i in range(12)] + [(90, "too few words"), (91, None), (None, prose(r, 20))]
    rows = [(100 + i, prose(r, 150)) for i in range(10)]
    for k, (item, text) in enumerate(items[:12]):
        words = text.split()
        edited = [w if j != len(words) // 2 else "edited" for j, w in enumerate(words)]
        inserted = words[: len(words) // 3] + ["more"] + words[len(words) // 3 :]
        rows += [(k, f"{prose(r, 30)} {text.upper()} {prose(r, 9)}"), (20 + k, prose(r, 5) + "\n" + " ".join(edited)), (40 + k, " ".join(inserted) + " " + prose(r, 60)), (60 + k, text)]
    own = docs(spark, rows + ODD)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): round(x.similarity, 9) for x in decontaminate.leaks(own, bench).collect()}

    def grams(text):
        w = (text or "").lower().split()
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    wanted = {}
    for k, t in rows + ODD:
        g = grams(t)
        for item, text in items:
            want = Counter(grams(text))
            n = sum(want.values())
            for a in range(len(g) - n + 1) if n else ():
                both = sum((Counter(g[a : a + n]) & want).values())
                if both / (2 * n - both) >= 0.8:
                    wanted[k, item] = max(wanted.get((k, item), 0), round(both / (2 * n - both), 9))
    assert got == wanted and len(got) > 20
    clean = decontaminate.without_leaks(own, bench)
    assert Counter(x.doc_id for x in clean.collect()) == Counter(k for k, _ in rows + ODD if k not in {d for d, _ in wanted})
    assert clean.columns == own.columns
    assert decontaminate.leaks(own, bench.limit(0)).count() == 0 and decontaminate.leaks(own.limit(0), bench).count() == 0


def test_leaks_of_swapped_halves_and_of_short_documents(spark):
    r = random.Random(9)
    items = [(i, " ".join(f"v{r.randrange(4000)}" for _ in range(n))) for i, n in enumerate((59, 40, 45, 15, 30))]
    rows = []
    for i, t in items:
        w = t.split()
        swapped = w[len(w) // 2 :] + w[: len(w) // 2]
        rows += [(10 * i, " ".join(swapped)), (10 * i + 1, " ".join([*prose(r, 30).split(), *swapped, *prose(r, 30).split()]))]
        rows += [(10 * i + 2, " ".join(w[:-1])), (10 * i + 3, " ".join(w[1:])), (10 * i + 4, " ".join(w[: len(w) // 2]))]
    found = decontaminate.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()

    def grams(w):
        return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))

    expected = {}
    for d, t in rows:
        w = t.lower().split()
        for i, item in items:
            of, n = grams(item.split()), len(item.split())
            alike = [sum((g & of).values()) / sum((g | of).values()) for g in (grams(w[s : s + n]) for s in range(max(1, len(w) - n + 1)))]
            if max(alike) >= 0.8:
                expected[d, i] = (max(alike), alike.index(max(alike)), min(n, len(w)))
    assert {(0, 0), (1, 0), (2, 0), (32, 3), (33, 3)} <= set(expected)
    assert {(x.doc_id, x.item_id): (x.similarity, x.first_word, x.n_words) for x in found} == {k: pytest.approx(v) for k, v in expected.items()}


def test_clean_rows_of_a_leaking_id_stay(spark):
    r = random.Random(31)
    item = prose(r, 30)
    rows = [(None, item), (None, prose(r, 40)), (5, prose(r, 20) + " " + item), (5, prose(r, 40)), (6, None)]
    clean = decontaminate.without_leaks(docs(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {(x.doc_id, x.text) for x in clean.collect()} == {rows[1], rows[3], rows[4]}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_index_holds_every_fingerprint_in_the_radius(spark):
    r = random.Random(12)
    used = decontaminate.BLOCKS * decontaminate.BLOCK_BITS
    pairs = []
    for _ in range(200):
        fp = [r.getrandbits(used) for _ in range(decontaminate.LONGS)]
        other = list(fp)
        for b in r.sample(range(used * decontaminate.LONGS), r.randrange(decontaminate.RADIUS + 1)):
            other[b // used] ^= 1 << b % used
        pairs.append((fp, other, sum((x ^ y).bit_count() for x, y in zip(fp, other))))
    frame = spark.createDataFrame(pairs, "p array<long>, q array<long>, n int")
    assert frame.where(F.arrays_overlap(decontaminate.variants("p"), decontaminate.blocks("q"))).count() == 200
    assert frame.where((decontaminate.differing("p", "q") == F.col("n")) & (decontaminate._first_block("p", "q") >= 0)).count() == 200


def test_fingerprints_against_counting(spark):
    r = random.Random(13)
    frame = spark.createDataFrame([([signed(r.getrandbits(64)) for _ in range(n)],) for n in (1, 2, 9, 700, 70_000)], "f array<long>")
    hashes = F.expr(f"transform(sequence(0, {decontaminate.LONGS - 1}), k -> transform(f, x -> xxhash64(x, k)))")
    rows = frame.select(decontaminate.fingerprint("f").alias("fp"), hashes.alias("h")).collect()
    for x in rows:
        for fp, h in zip(x.fp, x.h):
            u = np.array(h, np.int64).view(np.uint64)
            ones = [int(((u >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(decontaminate.BLOCKS * decontaminate.BLOCK_BITS)]
            assert fp == sum(1 << b for b, n in enumerate(ones) if 2 * n > len(h))


def test_leaks_equal_counting_every_window_in_sql(spark):
    import duckdb

    r = random.Random(41)
    few = ["aa", "bb", "cc", "dd"]  # so shingles repeat, within items and texts
    items = [(i, " ".join(r.choice(few[: 1 + i % 4]) for _ in range(n))) for i, n in enumerate((1, 2, 3, 4, 5, 6, 9, 14, 30, 31, 60, 60))]
    items += [(20, prose(r, 1000)), (21, prose(r, 40)), (22, "Odd Words"), (23, ""), (24, None), (25, items[9][1]), (26, " ".join(["zz"] * 12 + prose(r, 20).split()))]
    rows = [(i, " ".join(r.choice(few[: 1 + i % 4]) for _ in range(r.choice([0, 1, 3, 8, 40, 120])))) for i in range(40)]
    for k, (i, t) in enumerate(x for x in items if x[1]):
        w = t.split()
        half = w[len(w) // 2 :] + w[: len(w) // 2]
        rows += [(100 + k, f"{prose(r, 20)} {t} {prose(r, 10)}"), (200 + k, " ".join(half)), (300 + k, " ".join(w[: -(len(w) // 8) or None])), (400 + k, f"{t} {' '.join(half)} {t.upper()}"), (500 + k, f"{prose(r, 4)} {' '.join([*w[:3], 'x', *w[4:]])}")]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows + [x for x in ODD[:-1] if x[0]])
    db.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    wanted = {x[:2]: (round(x[2], 9), *x[3:]) for x in db.execute(decontaminate.OP7_SQL).fetchall()}
    got = decontaminate.leaks(docs(spark, rows + ODD), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id): (round(x.similarity, 9), x.first_word, x.n_words) for x in got.where("doc_id is not null").collect()} == wanted
    assert len(wanted) > 100 and {20, 0, 3, 22} <= {i for _, i in wanted}


# personal data

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(digits))) % 10 == 0


def slow_spans(text):
    out = {}
    for kind, pattern in KINDS.items():
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out[kind].append((m.start(), m.end()))
    return out


def test_base_spans_against_brute_force(spark):
    r = random.Random(13)
    bits = ["a@b.c", "@", ".", "+1", "(555)", " 12-34 ", "4539578763621486", "4539 5787 6362 1486", "1.2.3.4", "256.1.1.1", "001.002.3.4.5", "x_y%", "é", "日本", " ", "-", "9", "a@b", "\n", "+49 (30) 555-0199"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randrange(40)))) for i in range(400)] + ODD + [(9100, "1" * 60_000), (9101, "a" * 60_000 + "@b.co"), (9102, "1 " * 30_000)]
    got = pii.personal_data(docs(spark, rows))
    texts = defaultdict(list)
    for k, t in rows:
        texts[k].append(t)
    n = 0
    for x in got.collect():
        wanted = slow_spans(texts[x.doc_id][0])
        for kind in KINDS:
            assert [(s.start, s.end) for s in x[kind]] == wanted[kind], (kind, texts[x.doc_id])
            n += len(wanted[kind])
    assert got.count() == len(rows) and n > 300
    assert pii.personal_data(docs(spark, [])).count() == 0


def test_patterns_discover_unseen_identifiers_and_masking(spark):
    r = random.Random(14)
    secret = lambda: hashlib.md5(str(r.random()).encode()).hexdigest()
    rows = [(i, f'{prose(r, 12)} token = "{secret()}" {prose(r, 5)}') for i in range(8)]
    rows += [(20, 'the token = "XYZ-77-pq" was here'), (21, 'a note: chapter77 and "quoted99 words"'), (22, "write to é@x a.b@c.de, +1 (132) 555-1352 now"), *ODD]
    rows += [(30 + i, f"a note: {w} more") for i, w in enumerate(WORDS[:9])]
    own = docs(spark, rows)
    found = {x.doc_id: [(s.start, s.end) for s in x.found] for x in pii.personal_data(own).collect()}
    assert [rows[8][1][a:b] for a, b in found[20]] == ["XYZ-77-pq"] and found[21] == [] and all(len(found[i]) == 1 for i in range(8))
    masked = {x.doc_id: x for x in pii.mask(own).collect()}
    assert masked[20].text == 'the token = "[FOUND]" was here' and masked[22].text == "write to é@x [EMAIL], [PHONE] now"
    assert masked[9001].text is None and masked[9004].text == "x" * 300_000 and pii.mask(own).columns == own.columns
    assert pii.mask(own).count() == len(rows)


def test_plain_words_before_finds_are_patterns(spark):
    r = random.Random(15)
    rows = [(i, f"{prose(r, 9)} reach me at u{i}.x@mail.de {prose(r, 4)} or call +1 (132) 555-{1000 + i} {prose(r, 3)}") for i in range(9)]
    rows += [(20, "so reach me at QX1234567 today"), (21, "please or call QX-1234-77 then"), (22, f"{prose(r, 5)} AB1234567 {prose(r, 5)}"), *ODD]
    rows += [(30 + i, f"the number {1000000 + i} and the {w} stand") for i, w in enumerate(WORDS[:9])]
    rows += [(50 + i, f"the card 4539578763621486{i} here the card {w} there") for i, w in enumerate(WORDS[:9])]
    rows += [(70 + i, f"write to v{i}.y@mail.de and write to {w} too") for i, w in enumerate(WORDS[:9])] + [(90, "write to AB1234567 now")]
    own = docs(spark, rows)
    found = {x.doc_id: [dict(rows)[x.doc_id][s.start : s.end] for s in x.found] for x in pii.personal_data(own).collect() if x.doc_id is not None and x.doc_id < 9000}
    assert found[20] == ["QX1234567"] and found[21] == ["QX-1234-77"] and found[22] == []
    assert found[90] == []  # half of what stands behind 'write to' are plain words
    assert all(found[30 + i] == [] for i in range(9))
    # the counts of plain patterns against a slow count
    entities = pii.search(own)
    wanted = spark.createDataFrame([("me at ",), ("at ",), ("the ",), ("write to ",), ("nowhere ",)], "pattern string")
    got = {x.pattern: x.places for x in pii._counts(F.col("text"), own, wanted).collect()}
    slow = Counter()
    for _, t in rows:
        u = re.findall(r"[^\W]+[^\w+]*", re.sub(r"[ \t\r\n]+", " ", (t or "").lower()))
        for i, w in enumerate(u[:-1]):
            slow.update({w, (u[i - 1] if i else "") + w})
    assert got == {p: slow[p] for p in ("me at ", "at ", "the ", "write to ")} and entities.count() == len(rows)


def test_patterns_that_are_joined_find_the_same(spark):
    r = random.Random(16)
    rows = [(i, f'{prose(r, 6)} token = "{hashlib.md5(str(i).encode()).hexdigest()}" a.b@c.de') for i in range(8)] + [(20, 'token = "XYZ-77-pq"'), (21, 'token = "XYZ-77-pq" or token = "ABC-11-rs"'), *ODD]
    own = docs(spark, rows)
    found = [sorted((str(x.doc_id), str(x.found)) for x in pii.personal_data(own, most_bytes=n).collect()) for n in (1 << 20, -1)]
    masked = [sorted((str(x.doc_id), x.text or "") for x in pii.mask(own, most_bytes=n).collect()) for n in (1 << 20, -1)]
    assert found[0] == found[1] and masked[0] == masked[1] and ("21", 'token = "[FOUND]" or token = "[FOUND]"') in masked[0]


# licences


def test_licence_scan():
    finder = license.automaton()

    def scan(t):
        return dict(zip([x.split()[0] for x in license.RESULT.split(", ")][1:], license.scan(t, finder)))

    a = scan("Released under the MIT License. mit, license; GNU General\nPublic LICENSE, version 3")
    assert (a["n_words"], a["n_base"], a["first_word"], a["last_word"], a["base_labels"], a["labels"]) == (13, 3, 3, 8, "gpl,mit", "gpl,gpl-3.0,mit")
    assert scan(None)["n_words"] == 0 and scan("")["labels"] == "" and scan("permit license")["n_base"] == 0 and scan("mité license")["n_base"] == 0
    b = scan("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */")
    assert b["expressions"] == "(mit or apache-2.0) and gpl-2.0-only with classpath-exception-2.0"
    assert b["labels"] == "apache-2.0,gpl-2.0-only with classpath-exception-2.0,mit"
    assert scan("Licensed under CC BY-NC 4.0.")["labels"] == "cc-by-nc" and scan("SPDX-License-Identifier: ???")["labels"] == ""
    assert scan("mit license mit license")["n_base"] == 2
    assert scan("SPDX-License-Identifier: see LICENSE file")["score"] == 0
    c = scan("SPDX-License-Identifier: MIT and text SPDX-License-Identifier: Apache-2.0\nspdx license identifier LicenseRef-own-1")
    assert (c["expressions"], c["labels"]) == ("mit; apache-2.0; licenseref-own-1", "apache-2.0,licenseref-own-1,mit")


NAMES = ("mit", "isc", "zlib", "gpl-2.0-only", "apache-2.0")


@pytest.mark.parametrize(
    "text, order",
    [
        ("mit or isc and zlib", "mit isc zlib and or"), ("(mit or isc) and zlib", "mit isc or zlib and"), ("mit and isc with llvm-exception or zlib", "mit isc llvm-exception with and zlib or"), ("mit isc", "mit"),
        ("or mit", ""), ("(mit", ""), ("mit and", "mit"), ("mit.", "mit"), ("mit and word", "mit"), ("mit with isc", "mit"), ("(mit) with llvm-exception", "mit"), ("mit or (isc and (zlib))", "mit isc zlib and or"),
    ],
)
def test_shunting_yard(text, order):
    assert " ".join(license.postfix(text)) == order


def test_expressions_are_exact_at_any_size():
    r = random.Random(51)

    def made(depth):
        if not depth or r.random() < 0.2:
            return r.choice(NAMES) + (" with llvm-exception" if r.random() < 0.1 else "")
        a, op, b = made(depth - 1), r.choice(("and", "or")), made(depth - 1)
        return f"({a}) {op} ({b})" if r.random() < 0.5 and "with" not in a + b else f"{a} {op} {b}"

    for _ in range(500):
        text = made(r.randrange(6))
        order = license.postfix(text)
        for _ in range(4):
            holds = {n: r.random() < 0.5 for n in NAMES}
            named = re.sub(r" with llvm-exception", "", text)
            wanted = eval(re.sub("|".join(map(re.escape, NAMES)), lambda m: str(holds[m[0]]), named))
            assert license.evaluate(order, holds.get) == license.evaluate(license.postfix(license.written(order)), holds.get) == wanted, text
    seven = " and ".join(f"(mit or {n})" for n in ("isc", "zlib", "ncsa", "curl", "x11", "ruby", "vim"))
    assert license.written(license.postfix(seven)) == seven and license.evaluate(license.postfix(seven), lambda n: n == "mit")
    deep = "(" * 20_000 + "mit" + ")" * 20_000
    assert license.postfix(deep) == ["mit"]
    wide = " or ".join(["mit and isc"] * 20_000)
    assert license.written(license.postfix(wide)) == wide


def slow_scan(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def places(phrase):
        p = phrase.split()
        return [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]

    base = [(i, label) for phrase, label in license.BASE.items() for i in places(phrase)]
    all_found = [(i, phrase) for phrase in [*license.BASE, *license.MORE, license.TAG] for i in places(phrase)]
    rest, labels = 1.0, {x for _, x in base}
    for i, phrase in all_found:
        longer = any(j == i and len(other) > len(phrase) for j, other in all_found)
        if phrase in license.BASE:
            rest *= 1 - license.BASE_WEIGHT
        elif phrase in license.MORE and not longer:
            labels.add(license.MORE[phrase][0])
            rest *= 1 - license.MORE[phrase][1]
    edges = [m for m in re.finditer("spdx[-]license[-]identifier|spdx license identifier", low)]
    edges = [m for m in edges if not re.match(r"[a-z0-9\x80-\U0010ffff]", low[m.start() - 1 : m.start()] or " ") and not re.match(r"[a-z0-9\x80-\U0010ffff]", low[m.end() : m.end() + 1] or " ")]
    for m, after in zip(edges, [*(x.start() for x in edges[1:]), len(low)]):
        line = re.split(r"[^\x20-\x7e\t]", low[m.end() : after])[0].strip(" \t").removeprefix(":")
        tokens = re.findall(r"[()]|[a-z0-9](?:[a-z0-9.:-]*[a-z0-9])?\+?|\S", line)
        for n in range(len(tokens), 0, -1):  # the longest head that a grammar of its own reads
            if (got := grammar(tokens[:n])) is not None:
                labels |= got
                rest *= 1 - license.TAG_WEIGHT
                break
    at = [i for i, _ in base]
    return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1 - rest


def grammar(tokens):
    """The labels of a whole expression, else None: or of and of names or brackets."""
    at = 0

    def term():
        nonlocal at
        if at < len(tokens) and tokens[at] == "(":
            at += 1
            got = either("or")
            if got is None or at >= len(tokens) or tokens[at] != ")":
                return None
            at += 1
            return got
        if at < len(tokens) and license.NAME.fullmatch(tokens[at]):
            name = tokens[at]
            at += 1
            if at + 1 < len(tokens) and tokens[at] == "with" and license.EXCEPTION.fullmatch(tokens[at + 1]):
                name, at = f"{name} with {tokens[at + 1]}", at + 2
            return {name}
        return None

    def either(op):
        nonlocal at
        got = either("and") if op == "or" else term()
        while got is not None and at < len(tokens) and tokens[at] == op:
            at += 1
            more = either("and") if op == "or" else term()
            got = None if more is None else got | more
        return got

    got = either("or")
    return got if at == len(tokens) else None


def test_scan_against_brute_force():
    r, finders = random.Random(52), license.automaton()
    bits = [*license.BASE, *license.MORE, "SPDX-License-Identifier:", "spdx license identifier", "xspdx-license-identifier: mit", "MIT", "or", "and", "with", "(", ")", "Apache-2.0", "classpath-exception-2.0", "word", "é", "license", "general", "\n", ", ", "cc", "by", "nc"]
    for _ in range(1500):
        text = "".join(r.choice(bits) + r.choice([" ", " ", "\n", "-", ""]) for _ in range(r.randrange(25)))
        got = license.scan(text, finders)
        wanted = slow_scan(text)
        assert got[:6] == wanted[:6] and got[6] == pytest.approx(wanted[6]), text


def test_many_tags_take_linear_time():
    import time

    finders, began = license.automaton(), time.time()
    got = license.scan("SPDX-License-Identifier: see file " * 20_000, finders)
    assert got[0] == 100_000 and got[5] == "" and time.time() - began < 2


def test_licence_table(spark):
    got = license.scan_licenses(docs(spark, ODD + [(1, "MIT License")]))
    assert got.count() == len(ODD) + 1 and got.where("base_labels = 'mit'").first().key == 1
    assert license.scan_licenses(docs(spark, [])).count() == 0


# toxicity


def test_toxicity_is_learned_from_bags_and_located(spark):
    r = random.Random(15)
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        sentences = [prose(r, 8).replace(".", "") + "." for _ in range(r.randrange(2, 12))]
        if bad:
            sentences.insert(r.randrange(len(sentences)), f"You {r.choice(['zaxun', 'qebol'])}{r.choice(['', 'ist'])} there.")
        rows.append((i, " ".join(sentences)))
        labels.append((i, 1, int(bad)))
    own = docs(spark, rows + ODD)
    marks = spark.createDataFrame(labels + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(own, marks)
    got = {x.key: x for x in toxicity.score(own, model).collect()}
    held = [x.doc_id for x in own.select("doc_id").where(toxicity.held_out(F.col("doc_id"))).collect() if x.doc_id is not None and x.doc_id < 400]
    assert len(held) > 40 and all((got[i].score >= 0.5) == (i % 5 == 0) for i in held)
    worst = got[5]
    assert re.search("zaxun|qebol", dict(rows)[5][worst.worst_start : worst.worst_end]) and worst.n_offending == 1
    assert got[9001].score == got[9002].score < 0.2 and 0 <= got[None].score <= 1
    assert toxicity.score(own, toxicity.fit(own, marks.limit(0))).where("score <> 0").count() == 0
    assert toxicity.score(own.limit(0), model).count() == 0


def test_noisy_or_and_its_gradient_against_brute_force():
    import math

    r = random.Random(61)
    bags = [(r.random() < 0.4, [[w for w in range(6) if r.random() < 0.4] or [0] for _ in range(r.randrange(5))]) for _ in range(30)]
    x = np.array([r.uniform(0, 3) for _ in range(6)] + [-1.5])

    def likelihood(x):
        total, leak = 0.0, 1 / (1 + math.exp(-x[-1]))
        for y, sentences in bags:
            clean = 1 - leak
            for s in sentences:
                clean *= 1 - 1 / (1 + math.exp(4.0 - sum(x[w] for w in s)))
            total += math.log(1 - clean if y else clean)
        return total

    value, slopes = toxicity.Bags(bags, 6).slopes(x, -4.0)
    assert value == pytest.approx(likelihood(x))
    for i in range(7):
        step = np.eye(7)[i] * 1e-6
        assert slopes[i] == pytest.approx((likelihood(x + step) - likelihood(x - step)) / 2e-6, rel=1e-4, abs=1e-6)
    before = likelihood(np.array([0.0] * 6 + [-3.0]))
    weights, leak = toxicity.train(bags, 6, penalty=0.0)
    assert likelihood(np.append(weights, math.log(leak / (1 - leak)))) > before and (weights >= 0).all()


def test_toxicity_scores_are_noisy_ors():
    import math

    model = toxicity.Model({"bad": 3.0, "wor-": 2.0, "worse": 1.5}, -4.0, 0.05)
    known = toxicity.Known(model.weights)
    sentence = lambda *w: 1 / (1 + math.exp(4.0 - sum(w)))
    score, found = model.score("All bad bad. Fine!\nWorse and BAD? word", known)
    wanted = [sentence(3.0), sentence(2.0, 1.5, 3.0), sentence(2.0)]
    assert [p for *_, p in found] == pytest.approx(wanted) and score == pytest.approx(1 - 0.95 * math.prod(1 - p for p in wanted))
    assert model.score("nothing here", known) == (0.05, []) and model.score(None, known) == (0.05, [])


# urls


def test_verdicts_equal_sql(spark, tmp_path):
    import duckdb

    r = random.Random(71)
    hosts = [f"{a}{b}" for b in ("spam.com", "good.org", "x.co.uk", "y.co.uk", "lone", "example.com", "example.net") for a in ("", "a.", "b.", "c.d.")]
    rates = {h: r.choice([0.05, 0.2, 0.95]) for h in hosts}
    pages, labels = [(1, None), (2, "no scheme"), (3, "x://")], []
    for i in range(10, 1500):
        h = r.choice(hosts[:4]) if i % 3 == 0 else r.choice(hosts)
        pages.append((i, f"http://{h.upper() if i % 5 == 0 else h}{r.choice(['/en/7', '/de/88', '/es/', '?q', '', '/x#y'])}"))
        if r.random() < 0.5:
            bad = r.random() < rates[h]
            labels.append((i, *r.choice([(0, 0), (1, 1), (0, None)] if bad else [(1, 0), (None, 0), (1, None), (None, None)])))
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    db = duckdb.connect()
    for t in ("pages", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = {x[0]: tuple(x) for x in urls.op10_urls(spark, str(tmp_path)).collect()}
    wanted = {x[0]: x for x in db.execute(urls.OP10_SQL).fetchall()}
    assert got.keys() == wanted.keys() and {x[4] for x in wanted.values()} == {"allow", "block"}
    for k, w in wanted.items():
        assert got[k][:5] == w[:5] and got[k][5:] == pytest.approx(w[5:], abs=2e-6), (got[k], w)
    assert any(w[3] is None and w[4] == "block" for w in wanted.values())


def test_rules_and_parts(spark):
    rows = [
        (1, "http://A.Example.COM/en/7x?q", "a.example.com", "/en/7x", "example.com/en/7", "allow"), (2, "https://x.com/en/1#f", "x.com", "/en/1", "com/en/", "block"),
        (3, "http://com/en/", "com", "/en/", "com/en/", "block"), (4, "http://b.example.net/de/88", "b.example.net", "/de/88", "example.net/de/8", "block"),
        (5, "http://b.example.net/de/9", "b.example.net", "/de/9", "net/de/", "allow"), (6, "x://É.org/es/?a://b", "É.org", "/es/", "org/es/", "block"),
        (7, "notexample.com/en/7", "", "", None, "allow"), (8, None, "", "", None, "allow"), (9, "http://h?x://y", "h", "", None, "allow"), (10, "http://notcom/en/", "notcom", "/en/", None, "allow"),
        (11, "a://\nb\n/p", "\nb\n", "/p", None, "allow"),
    ]
    pages = spark.createDataFrame([(r[0], r[1], "h", "p", "b") for r in rows], "page_id long, url string, host string, path string, bad string")
    none = spark.createDataFrame([], "doc_id long, bad int")
    got = sorted(tuple(x) for x in urls.judge_urls(pages, none).select("key", "host", "path", "rule", "verdict").collect())
    assert got == [(r[0], *r[2:]) for r in rows]
    assert urls.judge_urls(pages.limit(0), none).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    rows = [(i, f"http://bad.spam.com/{i}") for i in range(40)] + [(100 + i, f"http://new.spam.com/{i}") for i in range(2)] + [(200 + i, f"http://h{i}.good.org/{i}") for i in range(60)]
    outcomes = [(i, 1) for i in range(30)] + [(100, 1)] + [(200 + i, int(i == 7)) for i in range(60)] + [(3, None), (3, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {x.host: x for x in urls.judge_urls(pages, spark.createDataFrame(outcomes, "doc_id long, bad int")).collect()}
    assert got["bad.spam.com"].verdict == "block" and got["h1.good.org"].verdict == "allow" and got["h7.good.org"].verdict == "allow"
    assert got["bad.spam.com"].low > got["new.spam.com"].low and got["h7.good.org"].rate < 0.9 and got["new.spam.com"].rate > got["h7.good.org"].rate
    domain = spark.createDataFrame([("a.b.co.uk",), ("b.com",), ("x",), ("",)], "h string").select(urls.registered_domain(F.col("h")))
    assert [x[0] for x in domain.collect()] == ["b.co.uk", "b.com", "x", ""]


def test_no_clash(spark):
    assert no_clash(spark.createDataFrame([], "Mark int, _mark int"), "mark", "mark") == ["__mark", "___mark"]


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    r = random.Random(17)
    leak = prose(r, 30)
    good = [(i, prose(r, 90)) for i in range(30)]
    rows = good + [(40, good[3][1]), (41, prose(r, 50) + " " + leak + " " + prose(r, 50)), (42, "few words"), (43, prose(r, 60) + " a.b@c.de " + prose(r, 30)), *ODD]
    d = tmp_path / "sf"
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    table, seen = spark.read.parquet(str(d / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, table, str(d)).write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        seen[name] = table
    clean = set(range(30))
    assert {x.doc_id for x in seen["quality"].collect()} == clean | {40, 41, 43}
    assert {x.doc_id for x in seen["near_duplicates"].collect()} == clean | {41, 43}
    assert {x.doc_id for x in seen["decontaminate"].collect()} == clean | {43}
    masked = seen["pii"].where("doc_id = 43").first()
    assert "[EMAIL]" in masked.text and masked.n_chars == len(masked.text)
    assert all(seen[n].columns == ["doc_id", "text", "lang", "source", "n_chars"] for n in list(seen)[:-1])
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(d)).collect()} == clean | {43}


ODD_COLUMNS = ["doc_id", "text", "n_chars", "a.b", "with blank", "back`quote", "Mark", "row", "own", "counts", "n", "cues"]


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_keep_odd_columns_and_empty_tables(spark, tmp_path, empty):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    r = random.Random(18)
    text = prose(r, 60)
    rows = [] if empty else [(1, text, 9, 1, "x", None, 2, 3, 4, 5, 6, 7), (1, text, 9, 1, "x", None, 2, 3, 4, 5, 6, 7), (1, text, 9, 0, "y", "z", 2, 3, 4, 5, 6, 7), (2, None, None, *[None] * 9), (None, prose(r, 50) + " a@b.co", 5, *[1] * 9)]
    schema = ", ".join(f"`{c.replace('`', '``')}` {'string' if c in ('text', 'with blank', 'back`quote') else 'long'}" for c in ODD_COLUMNS)
    rows = [tuple(str(x) if i in (1, 4, 5) and x is not None else x for i, x in enumerate(row)) for row in rows]
    table = spark.createDataFrame(rows, schema)
    d = tmp_path / "sf"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame([] if empty else [(1, prose(r, 20))], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, table, str(d))
        if name != "packing":
            assert made.columns == ODD_COLUMNS
        made.write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        if name == "near_duplicates" and not empty:  # of rows with equal id and text the one whose columns come first stays
            assert sorted((str(x.doc_id), x["a.b"]) for x in table.collect()) == [("1", 0), ("None", 1)]
        if name == "pii" and not empty:
            assert {x.text.split()[-1] for x in table.where("doc_id is null").collect()} == {"[EMAIL]"}
    assert {x.doc_id for x in table.collect()} == (set() if empty else {1, None})
