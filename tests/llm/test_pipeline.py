import re

import corpus_pipeline as cp
from stemmata.llm import decontaminate, packing
from stemmata.llm.line_dedup import dedup_lines
from stemmata.llm.quality_rules import judge, learn
from stemmata.llm.simhash import one_of_each

from .test_filters import brute_hits, brute_lines
from .test_quality_simhash_packing import brute_fingerprint, check_bins, components


def brute_dropped(docs):
    """Texts without the lines that brute_lines() counts as dropped."""
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in t.split("\n")]
    held = {}
    for i, t in docs.items():
        for k in set(keys(t)):
            held.setdefault(k, []).append(i)
    gone = {k: max(v) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    return {i: "\n".join(x for x, k in zip(t.split("\n"), keys(t)) if k not in gone or gone[k] == i) for i, t in docs.items()}


def test_stages_match_brute_force(spark, small, tmp_path):
    documents, labels, benchmark = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rules = learn(documents, labels)
    want = {r["doc_id"]: r["text"] for r in judge(documents, rules).where("kept").select("row.*").collect()}
    docs, kept = documents, []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()} if k < 4 else docs.collect())
        if k < 4:
            assert tuple(docs.columns) == cp.COLUMNS
    assert kept[0] == want
    want = brute_dropped(want)
    assert kept[1] == want and sum(r[2] for r in brute_lines(list(kept[0].items()))) > 0
    ids = list(want)
    least = components(ids, [brute_fingerprint(want[i]) for i in ids])
    want = {i: want[i] for i, c in zip(ids, least) if i == c}
    assert kept[2] == want
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    dirty = {r[0] for r in brute_hits(list(want.items()), items, decontaminate.WINDOW) if r[5]}
    want = {i: t for i, t in want.items() if i not in dirty}
    assert kept[3] == want
    sizes = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t)), None, None) for i, t in want.items()]
    check_bins(sizes, [list(zip(b["doc_ids"], b["starts"], b["sizes"])) for b in kept[4]], packing.CAPACITY)
    assert sorted(b["bin_id"] for b in cp.run(spark, small).collect()) == sorted(b["bin_id"] for b in kept[4])


def test_stages_decide_by_row(spark):
    """Null and repeated ids: a row goes for its own text only, and one row of each group stays."""
    text = lambda k: " ".join(f"{w}{k}" for w in "one two three four five six seven eight nine ten".split())
    rows = [(1, text("a")), (None, text("a")), (None, text("b")), (2, text("c")), (3, text("c")), (3, text("d")), (3, text("d")), (4, text("e")), (4, text("e"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in one_of_each(docs).collect()), key=repr)
    assert got == sorted([rows[0], rows[2], rows[3], rows[5], rows[7]], key=repr)
    a, b = "a line that is in many texts", "a line that is in one text only"
    rows = [(None, f"{a}\nx"), (None, f"{b}\nx"), (1, f"{b}\n{a}"), (1, f"x\n{b} still\n{b}, too"), (2, a)]
    got = {(r["row"]["doc_id"], r["row"]["text"]): (r["n_dropped"], r["kept_text"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[0]: (1, "x"), rows[1]: (0, rows[1][1]), rows[2]: (1, b), rows[3]: (0, rows[3][1]), rows[4]: (0, a)}


def test_odd_rows_go_through_all_stages(spark, small, tmp_path):
    """Nulls, empty and long texts, repeated rows, further columns of clashing names, and an empty table."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, nr long, row string, component string"
    text = lambda k: " ".join(f"{w}{k}" for w in "one two three four five six seven eight nine ten eleven".split())
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [(1, text("a")), (1, text("a")), (None, text("b")), (None, None), (2, ""), (3, long), (4, " \n\n "), (5, text("c"))]
    rows = [(i, t, None if i == 3 else "en", None if i == 5 else "s", None, 7, "x", None) for i, t in texts]
    for label in ("rows", "none"):
        docs = spark.createDataFrame(rows if label == "rows" else [], kinds)
        for k, (_, stage) in enumerate(cp.STAGES):
            path = str(tmp_path / label / str(k))
            stage(spark, docs, small).write.parquet(path)
            docs = spark.read.parquet(path)
            if k < 4:
                assert tuple(docs.columns) == cp.COLUMNS
                left = sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect())
                want = [(0, text("b")), (1, text("a")), (3, long), (5, text("c"))]
                assert left == ([] if label == "none" else sorted(want + [(1, text("a"))]) if k < 2 else want)
        bins = docs.collect()
        assert sorted(i or 0 for b in bins for i in set(b["doc_ids"])) == ([] if label == "none" else sorted([0, 1, 5] + [3] * sum(3 in b["doc_ids"] for b in bins)))
