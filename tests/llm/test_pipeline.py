"""The pipeline against its stages one by one."""

import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import corpus_pipeline as p
from test_minhash import expected as near_expected
from test_mixing_sharding import water

from siltstone.llm import lines, mixing, packing, quality


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for _, stage in p.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, small).toPandas(), docs.schema)
        assert docs.columns == columns
        tables.append(docs)
    first, good, lined, single, mix = ({r["doc_id"]: r for r in t.collect()} for t in tables)
    assert set(good) < set(first) and set(lined) < set(good) and set(single) <= set(lined) and set(mix) <= set(single)
    assert all(good[d] == first[d] for d in good) and all(single[d] == lined[d] for d in single)
    lines = Counter(x for r in lined.values() for x in r["text"].split("\n") if x.strip())
    assert max(lines.values()) == 1
    sizes = {d: len((r["text"] or "").split()) for d, r in single.items()}
    copies = Counter(r["doc_id"] for r in tables[4].collect())
    assert max(copies.values()) <= mixing.EPOCHS
    whole = sum(sizes.values())
    assert abs(sum(sizes[d] * n for d, n in copies.items()) - whole) < 0.1 * whole
    packed = p.run(spark, small).collect()
    ids = packing.word_ids(packing.vocabulary())
    wanted = Counter({d: n * (len(ids(mix[d]["text"])) // 4 + 1) for d, n in copies.items()})
    assert Counter({d: sum(r["length"] for r in packed if r["doc_id"] == d) for d in wanted}) == wanted


def test_empty_documents(spark, small, tmp_path):
    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def plain_quality(rows):
    """Rows that pass the base rules and lie near a language's histograms, counted word by word."""
    of_class = {"Ll": "lower", "Lu": "upper", "L": "other letter", "M": "other letter", "N": "digit", "Z": "blank", "P": "mark", "S": "symbol"}

    def kind(c):
        if c in quality.SYMBOLS:
            return "symbol"
        name = unicodedata.category(c)
        return "blank" if c in quality.BLANKS else of_class.get(name) or of_class.get(name[0]) or "other"

    def apart(p, q):
        out = 0.0
        for k in {*p, *q}:
            a, b = p.get(k, 0), q.get(k, 0)
            out += sum(x * math.log2(2 * x / (a + b)) for x in (a, b) if x)
        return math.sqrt(max(out / 2, 0))

    def shares(counts):
        whole = sum(counts.values())
        return {k: n / whole for k, n in counts.items()}

    def split(text):
        return re.findall(r"[^\x20\x09-\x0D]+", text)

    words, classes = {}, {}
    for _, text, lang, _ in rows:
        if text is not None and lang is not None:
            words.setdefault(lang, Counter()).update(split(text))
            classes.setdefault(lang, Counter()).update(map(kind, text))
    common = {lang: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[: quality.COMMON_WORDS]] for lang, c in words.items() if c}

    def of_common(counts, lang):
        told = {w: counts[w] for w in common[lang]}
        return shares(told | {"": sum(counts.values()) - sum(told.values())})

    kept = []
    for row in rows:
        text = row[1] or ""
        own = split(text)
        grams = Counter(zip(own, own[1:], own[2:]))
        covered = {i + k for i, g in enumerate(zip(own, own[1:], own[2:])) if grams[g] > 1 for k in range(3)}
        if len(own) < 50 or 100 * len(covered) > 50 * len(own):
            continue
        far = min(apart(shares(Counter(map(kind, text))), shares(classes[lang])) for lang in common) if len(text) >= 200 and common else 0
        far_words = min(apart(of_common(Counter(own), lang), of_common(words[lang], lang)) for lang in common) if len(text) >= 200 and common else 0
        if far <= quality.MAX_CLASS_DISTANCE and far_words <= quality.MAX_WORD_DISTANCE:
            kept.append(row)
    return kept


def plain_lines(rows):
    """Texts short of repeated lines, from all pairs of lines."""
    first, of = {}, {}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for doc, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for n, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\x0b\x0c\r"):
                first.setdefault(line, (doc, n))
    of.update({x: x for x in first})
    for a, b in itertools.combinations(first, 2):
        if min(len(a), len(b)) >= lines.LEAST_CHARS and lines.within(a, b, lines.edits(min(len(a), len(b)))):
            x, y = sorted((root(a), root(b)), key=first.get)
            of[y] = x
    out = []
    for doc, text, *rest in rows:
        found = (text or "").split("\n")
        stay = [x for n, x in enumerate(found) if doc is None or not x.strip(" \t\x0b\x0c\r") or first[root(x)] == (doc, n)]
        had, has = ([x for x in some if x.strip(" \t\x0b\x0c\r")] for some in (found, stay))
        if has or not had or doc is None:
            out.append((doc, None if text is None else "\n".join(stay), *rest))
    return out


def plain_mix(rows):
    """Rows as often as the mix reads them."""
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r)
    order = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    goals = water(sizes, {s: 1 + i % 3 for i, s in enumerate(order)})

    def bucket(r):
        key = f"{'' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}"
        return int(hashlib.md5(f"{mixing.SEED}:{key}".encode()).hexdigest()[:3], 16)

    out = []
    for s, whole in sizes.items():
        mine = [r for r in rows if r[3] == s]
        times = int(goals[s] // whole) if whole else 0
        due, held, cut = goals[s] - times * whole, 0, -1
        by_bucket = Counter()
        for r in mine:
            by_bucket[bucket(r)] += size(r)
        for b in sorted(by_bucket):
            held += by_bucket[b]
            if due > 0 and held - by_bucket[b] / 2 <= due:
                cut = b
        out += [r for r in mine for _ in range(times + (bucket(r) <= cut))]
    return out


def test_run_as_by_brute_force(spark, documents, prose, tmp_path):
    rng = random.Random(8)
    good = [r for r in prose if len(r[1] or "") < 2500 and len((r[1] or "").split()) > 60][:30]
    rows = [(i, *r[1:]) for i, r in enumerate(good)]
    for i, (_, text, lang, source) in enumerate(good[:8]):  # copies, near copies, shared and edited lines
        words = text.split(" ")
        words[len(words) // 2] = "changed"
        rows += [(100 + i, text, lang, source), (200 + i, " ".join(words), lang, "b"), (300 + i, rng.choice(good)[1] + "\n" + text.split("\n")[0], lang, None)]
    for i, (_, text, lang, source) in enumerate(good[8:14]):  # the same words on other lines
        words = text.split()
        rows.append((500 + i, "\n".join(" ".join(words[k : k + 23]) for k in range(0, len(words), 23)), lang, source))
    rows += [(400, None, "en", "b"), (401, "", None, None), (402, "# $ % " * 200, "en", "b"), (403, "word " * 500, "en", None), (404, good[0][1] + "\n" + "x" * 4000, None, "c")]
    rows += [rows[0], rows[0], rows[-5]]  # repeated rows
    docs = documents(rows)
    for name in ("n_lines", "gone_id", "size", "bucket", "copies", "kept", "piece", "key"):
        docs = docs.withColumn(name, docs["lang"])
    docs.write.parquet(str(tmp_path / "documents.parquet"))

    kept = plain_quality(rows)
    lined = plain_lines(kept)
    alone = {d for d, _, _, first in near_expected([r[:2] for r in lined]) if first}
    single = [r for r in lined if r[0] in alone]
    mixed = plain_mix(single)
    assert len(rows) > len(kept) > len(lined) > 0 and len({r[0] for r in lined}) > len({r[0] for r in single}) and len(mixed) != len(single)
    ids_of = packing.word_ids(packing.vocabulary())
    wanted = Counter()
    for doc, text, *_ in mixed:
        raw = ids_of(text or "") + (1).to_bytes(4, "little")
        for n, at in enumerate(range(0, len(raw), 4 * packing.CAPACITY)):
            part = raw[at : at + 4 * packing.CAPACITY]
            wanted[doc, n, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    got = p.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == wanted
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in map(sorted, places.values()):
        assert found[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(found, found[1:])) and sum(found[-1]) <= packing.CAPACITY
