"""The pipeline stage by stage against brute force: rows that stay and go, texts left, every token packed once."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_text_operators import FOLD, WORD, folded, linked_components

import corpus_pipeline
from candlewick.llm import toxicity
from candlewick.llm.storage import materialize
from candlewick.llm.tokens import vocabulary_path

SF = "/root/testdata/sf0.001"
SPACES = re.compile("[ \t\n\x0b\f\r]+")
LETTERS = "0-9a-zÀ-ÖØ-öø-ÿ"


def planted(benchmark):
    """(doc_id, text, source): near copies, shared lines, empty shells, benchmark passages and toxic documents; toxic ids; labels."""
    rng = np.random.default_rng(13)
    some = lambda n: [f"v{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in rng.integers(0, 600, n)]
    rows = []
    base = some(90)
    for k in range(6):
        rows.append((10_000 + k, " ".join([*base[:k], *some(1), *base[k + 1 :]]), f"near{k}"))
    line = " ".join(f"menu{chr(97 + k)}" for k in range(12))
    rows += [(11_000 + k, " ".join(some(70)) + f"\n{line.upper() if k % 2 else line}  {k}", "shop") for k in range(8)]
    rows += [(12_000 + k, " ".join(some(20)) + "".join(f"\n{line} tail{x}" for x in "abcd"), "shells") for k in range(8)]
    for k, item in enumerate(benchmark[:6]):
        words = item.split()
        words[4] = "changed"
        rows.append((13_000 + k, " ".join([*some(40), *words, *some(40)]), "leak"))
    labels, toxic = [], set()
    for k in range(160):
        bad = k % 4 == 1
        rows.append((20_000 + k, " ".join([*some(60), *["vileslur", "thatgroup"] * bad]), "forum"))
        toxic |= {20_000 + k} if bad else set()
        if k % 16 < 12:
            labels.append((20_000 + k, int(bad)))
    rows += [(30_000, None, None), (30_001, "", "x"), (30_002, "a b " * 400, "x")]
    return rows, toxic, labels


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables with planted documents beside the given ones, and the planted toxic ids."""
    folder = tmp_path_factory.mktemp("corpus")
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows, toxic, marks = planted([r["text"] for r in bench.orderBy("item_id").collect()])
    made = [[{"doc_id": d, "text": t, "source": s, "n_chars": len(t or "")}.get(c) for c in docs.columns] for d, t, s in rows]
    docs.unionByName(spark.createDataFrame(made, docs.schema)).write.parquet(str(folder / "documents.parquet"))
    marked = [[{"doc_id": d, "toxic": t}.get(c) for c in labels.columns] for d, t in marks]
    labels.unionByName(spark.createDataFrame(marked, labels.schema)).write.parquet(str(folder / "labels.parquet"))
    bench.write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), toxic


def base_failed(text):
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    return len(w) < 50 or 100 * len(repeated) > 50 * len(w)


def normal(line):
    return SPACES.sub(" ", re.sub("[1-9]", "0", line.translate(FOLD))).strip(" ")


def after_quality(rows):
    """Texts by doc_id of the rows that the base and line rules keep, over-frequent lines taken out."""
    hosts = defaultdict(set)
    for r in rows:
        hosts[r["source"] or ""].add(r["text"] or "")
    kept = {}
    for host, texts in hosts.items():
        held = Counter(x for t in texts for x in {normal(line) for line in t.split("\n")} if x)
        often = {x for x, n in held.items() if n > max(5, len(texts) * 2 / 100)}
        for r in rows:
            if (r["source"] or "") != host or base_failed(text := r["text"] or ""):
                continue
            lines = text.split("\n")
            stay = [line for line in lines if normal(line) not in often]
            n, left = (sum(len(WORD.findall(line)) for line in x) for x in (lines, stay))
            if len(stay) == len(lines) or not (2 * left < n or left < 50):
                kept[r["doc_id"]] = "\n".join(stay)
    return kept


def pieces(text):
    for w in folded(text):
        m = re.fullmatch(rf"(.*[{LETTERS}])([!-/:-@\[-`{{-~]+)", w, re.S)
        yield from (m[1], m[2]) if m and m[2][0] != "|" else (w,)


def toxic_score(model, text):
    """The factorization machine's sum over all pairs."""
    own = sorted({model.place[b] for w in pieces(text) for b in toxicity._buckets(w) if model.place[b] >= 0})
    pairs = sum(model.v[i] @ model.v[j] for n, i in enumerate(own) for j in own[n + 1 :])
    return 1 / (1 + math.exp(-(model.w0 + sum(model.w[i] for i in own) + pairs)))


def overlaps(text, item):
    """Whether a run of 13 words of an item of 13 or more lies in a text with at most two substituted: all places are tried."""
    if len(text) < 13:
        return False
    same = text[:, None] == item[None, :]
    return sum(same[i : len(text) - 12 + i, i : len(item) - 12 + i].astype(np.int8) for i in range(13)).max() >= 11


def leaked(texts, items):
    known = {}
    coded = lambda t: np.array([known.setdefault(w, len(known)) for w in folded(t)], np.int32)
    items = [coded(t) for t in items]
    assert min(map(len, items)) >= 13
    return {d for d, t in texts.items() if any(overlaps(words, i) for words in [coded(t)] for i in items)}


def test_each_stage_equals_brute_force_on_its_own_input(spark, corpus):
    sf, toxic = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_duplicates", "benchmark_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    outs, columns = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        outs.append(materialize(stage(spark, outs[-1], sf), name))
        assert outs[-1].columns == columns
    rows = [df.collect() for df in outs]
    given, clean, mild, single, pure = ({r["doc_id"]: r["text"] for r in x} for x in rows)
    assert [len(x) for x in rows] == [len(x) for x in (given, clean, mild, single, pure)]

    assert clean == after_quality(rows[0])
    assert all(r["n_chars"] == len(r["text"]) for r in rows[1] if r["text"] != given[r["doc_id"]])
    assert set(range(11_000, 11_008)) <= set(clean) and not any("menua" in clean[d].lower() for d in range(11_000, 11_008))
    assert not {*range(12_000, 12_008), 30_000, 30_001, 30_002} & set(clean)

    model = toxicity.fit(outs[1], spark.read.parquet(f"{sf}/labels.parquet"))
    assert mild == {d: t for d, t in clean.items() if toxic_score(model, t) < 0.5}
    assert not toxic & set(mild) and len({*range(20_000, 20_160)} - toxic - set(mild)) <= 2

    groups = linked_components(mild)
    assert single == {d: t for d, t in mild.items() if groups[d][1] == d}
    assert [d for d in single if 10_000 <= d < 10_006] == [10_000]

    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    gone = leaked(single, items)
    assert pure == {d: t for d, t in single.items() if d not in gone}
    assert set(range(13_000, 13_006)) <= gone

    packed = corpus_pipeline.run(spark, sf).collect()
    from tokenizers import Tokenizer

    encoded = Tokenizer.from_file(vocabulary_path()).encode_batch(list(pure.values()), add_special_tokens=False)
    ids = {d: np.array([*e.ids, 1], "<u4") for d, e in zip(pure, encoded, strict=True)}
    want = sorted((d, k, s, len(i[s : s + 4096]), zlib.crc32(i[s : s + 4096].tobytes())) for d, i in ids.items() for k, s in enumerate(range(0, len(i), 4096)))
    assert sorted(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in packed) == want
    sequences = defaultdict(list)
    for r in packed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(places)])]
        assert [at for at, _ in sorted(places)] == ends[:-1] and ends[-1] <= 4096
    assert len(sequences) <= 1.01 * -(-sum(map(len, ids.values())) // 4096) + 1
