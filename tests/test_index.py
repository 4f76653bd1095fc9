"""Index build, search, analyses, refresh and sources on a small fixture."""

import os

import pytest
from pyspark.sql import functions as F

from phrasewell.functions import text as X
from phrasewell.operators import bodies, extract, index as I, lcep, risk
from phrasewell.operators.search import search, search_core
from phrasewell.plans import answers
from phrasewell.plans.scratch import ranked
from phrasewell.sources.corpus import scan_directory, scan_times
from phrasewell.streaming import refresh

FILES = {
    "src/kiln.ts": "kiln heat ramp KilnDriver setTarget holdPlateau",
    "tests/kiln.test.ts": "kiln check KilnDriver GlazeStub CoolingFault prepareKiln",
    "tests/helpers/glaze.ts": "GlazeStub mixSlip stirSlip pourSlip weighClay",
}
CODE = {
    "src/a.ts": "export class KilnDriver {\nfunction setTarget(x) {\n// note\n",
    "lib/b.ts": "run KilnDriver; setTarget; more words here\n",
    "tests/a.test.ts": "function checkKiln() {\nKilnDriver; GlazeStub\n",
    "tests/glaze.ts": "export default class GlazeStub {\n",
    "src/none.ts": None,
    "src/empty.ts": "",
}


def corpus(spark, files):
    return spark.createDataFrame(list(files.items()), "file_path string, text string")


@pytest.fixture(scope="module")
def small(spark):
    return I.build(corpus(spark, FILES), 0)


@pytest.fixture(scope="module")
def code(spark):
    return I.build(corpus(spark, CODE), 0)


def test_fixture_counts(small):
    stats = {r.file_path: r for r in small.files.collect()}
    assert [stats[p].token_len for p in FILES] == [6, 6, 5]
    assert small.number("avgdl", 0) == pytest.approx(17 / 3)
    df = {r.phrase: r.df for r in small.phrases.collect()}
    assert {p for p, n in df.items() if n == 2} == {"kiln", "KilnDriver", "GlazeStub"} and max(df.values()) == 2
    assert small.occ.where("is_def <> 0 or zone <> 0 or first_line <> 0").count() == 0


def test_ids_are_byte_ranks(small):
    assert [r.file_path for r in small.file_ids().orderBy("file_id").collect()] == sorted(FILES)
    names = [r.phrase for r in small.phrase_ids().orderBy("phrase_id").collect()]
    assert names == sorted(names)


def test_ranked_is_contiguous(spark):
    got = ranked(spark.range(1000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("k")).repartition(7), "k", "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 1001)) and [r.k for r in got] == sorted(r.k for r in got)


def test_kept_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    from phrasewell.plans import scratch

    monkeypatch.setattr(scratch, "_kept", [])
    at = str(tmp_path / "saved")
    I.build(corpus(spark, FILES), 0).save(at)
    paths = [p.removeprefix("file://") for p in scratch._kept]
    assert paths and all(map(os.path.isdir, paths))
    scratch.drop_kept(spark)
    assert not scratch._kept and not any(map(os.path.exists, paths))
    assert I.load(spark, at).occ.count() == 17


def test_null_and_empty_files(code):
    stats = {r.file_path: r for r in code.files.collect()}
    assert stats["src/none.ts"].token_len == 0 and stats["src/empty.ts"].comment_ratio == 0.0
    assert stats["src/a.ts"].comment_ratio == pytest.approx(1 / 3)


def test_search(small):
    assert search(small, "", 5).count() == 0
    top = search(small, "kiln heat ramp", 5).collect()
    assert top[0].file_path == "src/kiln.ts" and top == sorted(top, key=lambda r: -r.score)
    assert search_core(small, "KilnDriver", 10).count() == 2
    assert search(small, "zzzunknown qqqunknown", 5).count() == 0


def test_structure(code):
    assert [r.file_path for r in risk.who_calls(code, "KilnDriver").collect()] == ["lib/b.ts", "tests/a.test.ts"]
    assert risk.who_calls(code, "nothing").count() == 0
    assert {r.file_path for r in risk.latent_deps(code, "src/a.ts").collect()} == {"lib/b.ts", "tests/a.test.ts", "tests/glaze.ts"}
    assert risk.latent_deps(code, "nonexistent/file.go").count() == 0
    assert {r.file_path for r in risk.blast_radius(code, "src/a.ts").collect()} >= {"lib/b.ts"}
    assert [r.phrase for r in risk.find_fixtures(code, "src/a.ts", "tests/a.test.ts").collect()] == ["GlazeStub"]
    assert risk.find_fixtures(code, "src/a.ts", "missing.ts").count() == 0
    hops = risk.trace_callers(code, "KilnDriver", 2)
    assert hops.where("hop = 1").count() == 2
    with pytest.raises(ValueError):
        risk.trace_callers(code, "KilnDriver", 0)
    plan = risk.edit_plan(code, "class function")
    assert plan["edit"] and plan["risk"] in ("low", "moderate") and risk.edit_plan(code, "")["risk"] == "unknown"


def test_answers(code):
    assert answers.orient(code)["languages"] == {"ts": 6}
    row = answers.health(code).first()
    assert row.files == 6 and row.phrases > 0 and row.occurrences >= row.phrases
    assert '"risk"' in answers.code_search(code, "KilnDriver target", True, True)


def test_bodies(spark):
    store = spark.createDataFrame([("h1", "kilnStart", "x"), ("h2", "other", "y")], "hash string, name string, body string")
    assert bodies.by_hash(store, "h1").first().body == "x" and bodies.by_hash(store, "zz").count() == 0
    assert [r.hash for r in bodies.by_name(store, "KILN").collect()] == ["h1"]


def brute_contexts(files, chunks):
    """First occurrence with a left word among the first five of a spelling, per chunk of files in path order and lower-cased phrase."""
    import re

    paths, out, size = sorted(files), {}, max(1, len(files) // chunks)
    seen = {}
    for n, path in enumerate(paths):
        for line in (files[path] or "").split("\n"):
            for m in re.finditer("[a-zA-Z_][a-zA-Z0-9_]{2,}", line):
                k, p = n // size, m.group()
                seen[k, p] = seen.get((k, p), 0) + 1
                left = line[: m.start()].split()
                if seen[k, p] <= 5 and left and (k, p.lower()) not in out:
                    out[k, p.lower()] = left[-1][:30].lower()
    return out


def test_left_context_samples(spark):
    files = {f"f{i}.ts": f"fn target(a)\n(x) other{i} target" for i in range(4)}
    words = "kiln Kiln KILN ash clay-slip (kiln) x.kiln ash,clay".split()
    import random

    r = random.Random(4)
    files |= {f"g{i:02}.ts": "\n".join(" ".join(r.choices(words, k=r.randint(0, 5))) for _ in range(4)) for i in range(30)}
    for chunks in (1, 4, 7):
        i = I.build(corpus(spark, files), chunks)
        got = {(r.chunk, r.phrase_lc): r.word for r in lcep.contexts(i.files, i.raw, chunks).collect()}
        assert got == brute_contexts(files, chunks)


def test_extract_follows_the_expressions(spark):
    """What is read file by file is what the rules say as column expressions."""
    samples = ["def kiln(a):", "  # note on kiln", "<div class=clay id='x'>glaze</div>", "ab cd", "a quiet day", "x = 1", "\u3000wide\u00a0space kiln", "9lives kiln.fire(now)", "Ton für Ofen", "*", "kiln -> ash", "one two", "été aa bb", "\tlet pot: Clay = new Clay<Slip>(kiln)", "#define KILN", "#", "no \r inner", ""]
    files = {f"f{i}": "\n".join(samples[i:] + samples[:i]) + ["", "\n", "\r\n", "\n\n", "\r"][i % 5] for i in range(len(samples))} | {f"one{i}": t for i, t in enumerate(samples)} | {"none": None}
    c = corpus(spark, files).repartition(3)
    lines = I.lines_of(c).withColumn("zone", X.line_zone(F.col("line")))
    hits = F.transform(X.identifiers(F.col("line")), lambda p: F.struct(p.alias("phrase"), F.lit(1).alias("n"), F.lit(0).alias("d")))
    defs = F.when(F.col("zone") == 0, F.transform(X.definitions(F.col("line")), lambda p: F.struct(p.alias("phrase"), F.lit(0).alias("n"), F.lit(1).alias("d")))).otherwise(F.array().cast("array<struct<phrase:string,n:int,d:int>>"))
    want = lines.select("file_path", "line_no", "zone", F.inline(F.concat(hits, defs))).groupBy("phrase", "file_path").agg(F.max("d"), F.min("zone"), F.sum("n"), F.min("line_no"))
    got = extract.extract(c)
    assert sorted(map(tuple, got.where("phrase is not null").select("phrase", "file_path", "is_def", "zone", "cnt", "first_line").collect())) == sorted(map(tuple, want.collect()))
    facts = ["file_path", "content_len", "digest", "readable", "comment_ratio"]
    assert sorted(map(tuple, got.where("phrase is null").select(*facts).collect())) == sorted(map(tuple, I.file_facts(c).select(*facts).collect()))


def rows(index):
    numbers = sorted((r.key, r.value) for r in index.meta.where("key <> 'build_time'").collect())
    return sorted(map(tuple, index.occ.select("phrase", "file_path", "is_def", "zone", "cnt", "first_line").collect())), sorted(map(tuple, index.files.collect())), sorted(map(tuple, index.phrases.collect())), numbers


def varied(n):
    """Files with rare and common phrases after few and many left words, so that contexts override definitions."""
    return {f"m{i:02}.ts": f"fn rare{i % 5}(x)\nlet common = word{i}\nset{i} common\npub own{i} {{\nget steady\nget steady" for i in range(n)}


@pytest.mark.parametrize("chunks", [0, 3, 8])
def test_refresh_equals_full_build(spark, chunks):
    before = CODE | varied(24)
    base = I.build(corpus(spark, before), chunks)
    same, n = refresh.refresh(base, corpus(spark, before))
    assert n == 0 and same is base
    after = before | {"lib/b.ts": "setTarget(2); added = 1\n", "z.ts": "class Zed {\n", "a0.ts": "fn rare1 common"}
    del after["src/empty.ts"], after["m07.ts"]
    whole = rows(I.build(corpus(spark, after), chunks))
    now, n = refresh.refresh(base, corpus(spark, after))
    assert n == 5 and rows(now) == whole
    # Again from a refreshed index, and as a batch of changes.
    back, n = refresh.refresh(now, corpus(spark, before))
    assert n == 5 and rows(back) == rows(base)
    batch = {"lib/b.ts": after["lib/b.ts"], "z.ts": after["z.ts"], "a0.ts": after["a0.ts"], "src/empty.ts": None, "m07.ts": None, "gone.ts": None}
    merged, n = refresh.apply_batch(base, corpus(spark, batch))
    assert n == 5 and rows(merged) == whole
    if chunks == 8:
        assert rows(I.build(corpus(spark, after), 0))[0] != whole[0]  # contexts do matter here
    # More than the share from which a full build is cheaper.
    few = dict(list(after.items())[:3])
    now, n = refresh.refresh(base, corpus(spark, few))
    assert n >= 20 and rows(now) == rows(I.build(corpus(spark, few), chunks))


def test_contexts_have_no_limit_unless_one_is_given(spark):
    c = corpus(spark, varied(12))
    assert rows(I.build(c, 8, 11))[0] == rows(I.build(c, 0))[0] != rows(I.build(c, 8))[0]
    limited, n = refresh.refresh(I.build(c, 8, 12), corpus(spark, varied(12) | {"m00.ts": "fn other"}))
    assert n == 1 and rows(limited) == rows(I.build(corpus(spark, varied(12) | {"m00.ts": "fn other"}), 8, 12))


def test_partitions_do_not_matter(spark, code):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows(I.build(corpus(spark, CODE).repartition(5), 0)) == rows(code)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_save_and_load(spark, code, small, tmp_path):
    at = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        I.load(spark, at)
    first = code.save(at)
    assert rows(I.load(spark, at)) == rows(code) and I.versions(spark, at) == [first]
    small.save(at)
    assert rows(I.load(spark, at)) == rows(small)
    # A writer that dies before its marker leaves the newest complete version in force.
    half = tmp_path / "index" / "v=99999999999999999999-x"
    half.mkdir()
    (half / "_new").write_text("{}")
    assert rows(I.load(spark, at)) == rows(small)
    # Another schema is refused.
    (half / "_COMPLETE").write_text('{"schema": 1}')
    with pytest.raises(ValueError):
        I.load(spark, at)


def test_open_builds_what_is_missing(spark, code, tmp_path):
    calls = []

    def source():
        calls.append(1)
        return corpus(spark, CODE)

    for _ in range(2):
        assert rows(I.open_or_build(spark, str(tmp_path / "i"), source, 0)) == rows(code)
    assert len(calls) == 1


def test_directory_scan(spark, tmp_path):
    for name, data in {"a.ts": b"hello", "Makefile": b"all:", "x.makefile": b"all:", "node_modules/b.ts": b"no", ".git/c.ts": b"no", "d/e.py": b"\xff\xfe", "d/yarn.lock": b"x", "d/package-lock.json": b"{}", "d/img.png": b"x", ".h.ts": b"no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.file_path: r.text for r in scan_directory(spark, str(tmp_path)).collect()}
    assert got == {"a.ts": "hello", "x.makefile": "all:", "d/e.py": None}


def test_watch(spark, tmp_path):
    source, seen = tmp_path / "in", []
    spark.createDataFrame([("a.ts", "one", 1), ("a.ts", "two", 2), ("b.ts", None, 1)], "file_path string, text string, version long").write.parquet(str(source))
    stream = spark.readStream.schema("file_path string, text string, version long").parquet(str(source))
    q = refresh.watch(stream, lambda df, epoch: seen.append(sorted(map(tuple, df.collect()), key=str)), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert seen == [[("a.ts", "two"), ("b.ts", None)]]
    merged = refresh.merge_batch(corpus(spark, {"b.ts": "x", "c.ts": "y"}), spark.createDataFrame(seen[0], "file_path string, text string"))
    assert {r.file_path: r.text for r in merged.collect()} == {"a.ts": "two", "c.ts": "y"}


def test_follow_keeps_a_saved_index_fresh(spark, tmp_path):
    at, source = str(tmp_path / "index"), str(tmp_path / "in")
    I.build(corpus(spark, CODE), 8).save(at)
    kind = "file_path string, text string, version long"
    spark.createDataFrame([("lib/b.ts", "old text", 1), ("lib/b.ts", "setTarget(2)", 2), ("src/a.ts", None, 1), ("new.ts", "fn fresh()", 1)], kind).write.parquet(source)
    query = refresh.follow(spark.readStream.schema(kind).parquet(source), at, str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    after = CODE | {"lib/b.ts": "setTarget(2)", "new.ts": "fn fresh()"}
    del after["src/a.ts"]
    assert rows(I.load(spark, at)) == rows(I.build(corpus(spark, after), 8))


def test_poll_reads_only_what_time_points_at(spark, tmp_path):
    root, at = tmp_path / "tree", str(tmp_path / "index")
    root.mkdir()
    for name, text in (("a.ts", "fn kiln()"), ("b.py", "ash = 1")):
        (root / name).write_text(text)
    assert refresh.poll(spark, str(root), at, rounds=1) == 0 and len(I.versions(spark, at)) == 1
    old = scan_times(spark, str(root))
    old = spark.createDataFrame(old.collect(), old.schema)
    (root / "a.ts").write_text("fn glaze()")
    os.utime(root / "a.ts", (1, 10**9))
    (root / "c.ts").write_text("fn more()")
    assert sorted(map(tuple, refresh.touched_times(old, scan_times(spark, str(root))).collect())) == [("a.ts", "changed"), ("c.ts", "new")]
    assert refresh.poll(spark, str(root), at, seconds=0, rounds=2) == 2
    assert rows(I.load(spark, at)) == rows(I.build(scan_directory(spark, str(root))))


def test_tools_and_deadline(code):
    t = answers.tools(code)
    assert t["who_calls"]("KilnDriver") == [r.asDict() for r in risk.who_calls(code, "KilnDriver").collect()] and t["health"]()["files"] == 6
    assert t["code_search"]("KilnDriver target", True, True) == answers.code_answer(code, "KilnDriver target", True, True, None)
    assert answers.code_answer(code, "KilnDriver", False, True, deadline=-1.0)["who_calls"] == []
    row = answers.health(code).first()
    assert row.build_time > 0 and row.latency_ms > 0


def test_documents_with_null_source_or_lang_have_paths(spark, tmp_path):
    from phrasewell.sources.corpus import documents_corpus

    rows = [(1, "a", None, "s"), (2, "b", "en", None), (None, "c", "en", "s"), (5, "d", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.text: r.file_path for r in documents_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a": "tests/s/_/doc_1.ts", "b": "vendor/_/en/doc_2.js", "c": "src/s/en/doc__.ts", "d": "src/s/en/doc_5.ts"}
