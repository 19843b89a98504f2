from pathlib import Path

import corpus_pipeline
from rankflow.llm import mixing
from rankflow.llm.recompression import WINDOW

from .helpers import awkward_texts, repeats
from .test_simhash import plain, reach


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    texts = awkward_texts(7)
    rows = [(i, t, ["en", "de"][i % 2], ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{name}"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert frames[-1].columns == docs.columns
    tell, near, cut, mix, tokens = ({r["doc_id"]: r for r in f.collect()} for f in frames[1:])
    # language ID: texts without letters go
    assert set(tell) <= {i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    # near-dedup: the smallest id of each group of its input
    fps = {i: plain(r["text"]) for i, r in tell.items()}
    root = reach(set(fps.values()))
    low = {}
    for i in sorted(fps):
        low.setdefault(root[fps[i]], i)
    assert set(near) == set(low.values())
    # substring dedup, judged on its own input
    ids = sorted(near)
    seqs = [tuple(near[i]["text"].encode().split()) for i in ids]
    for i, s, gone in zip(ids, seqs, repeats(seqs, WINDOW)):
        want = near[i]["text"] if not any(gone) else b" ".join(w for w, g in zip(s, gone) if not g).decode()
        assert (cut[i]["text"], cut[i]["n_chars"]) == (want, len(want) if any(gone) else near[i]["n_chars"])
    # the mix: as many rows as copies
    decided = {r["id"]: r["copies"] for r in mixing.plan_mix(frames[3])[0].collect()}
    assert sum(decided.values()) == frames[4].count() and set(mix) == {i for i, n in decided.items() if n}
    # tokens decode to the text
    assert {i: r["text"] for i, r in tokens.items()} == {i: r["text"] for i, r in mix.items()}
    before, tables = scratch_files(spark), spark.catalog.listTables()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == frames[5].count()
    # of the whole run only the mix stays, which the result reads, and the scratch of none
    left = {p.parent.name.rsplit("-", 1)[0] for p in scratch_files(spark) - before}
    assert left == {"pipeline-mix_sources"}
    assert spark.catalog.listTables() == tables


def scratch_files(spark):
    """Files with rows in the scratch folder."""
    return set(Path(spark.conf.get("spark.checkpoint.dir")).glob("**/*.parquet"))
