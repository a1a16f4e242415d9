import hashlib
import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from kindred.llm import bpe, queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and with water house road light", "fr": "le des avec maison été jour nuit rue", "de": "der und mit haus wasser über straße licht"}


def corpus():
    rng = random.Random(31)
    rows = []
    for i in range(90):
        k = rng.choice(list(WORDS))
        lines = [" ".join(rng.choices(WORDS[k].split(), k=rng.randint(8, 20)) + [f"n{rng.randrange(40)}"]) for _ in range(rng.randint(1, 5))]
        if i % 3 == 0:
            lines.insert(0, "All rights reserved")
        rows.append((i, "\n".join(lines), k, f"s{i % 14}"))
    for i in range(12):  # near copies, one word changed
        w = rows[i * 3][1].split(" ")
        w[-1] = "changed"
        rows.append((100 + i, " ".join(w), rows[i * 3][2], f"s{i}"))
    rows += [(200, None, "en", "s1"), (201, "", "en", None), (202, " \n\t", None, "s2"), (203, "0 1 2 3", None, "s2"), (None, rows[1][1], rows[1][2], "s3"), (None, None, None, None)]
    rows += [rows[5], rows[5], (5, rows[5][1] + " more", rows[5][2], "s5")]
    return [(*r, len(r[1]) if r[1] else None) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), COLUMNS)


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def near_groups(texts, k=5):
    """Component (smallest id) of each id by brute force."""
    sets = {}
    for i, t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split(" ")
        w = [x for y in w for x in y.split()]
        if w:
            sets.setdefault(i, []).append({tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))})
    root = {i: i for i, _ in texts}
    for _ in root:
        for i in sets:
            for j in sets:
                if any(100 * len(x & y) >= 80 * len(x | y) for x in sets[i] for y in sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    return root


def test_language_stage_keeps_every_row_of_a_known_language(spark, docs):
    got = rows_of(corpus_pipeline.identify_language(spark, docs, ""))
    want = [r for r in corpus() if r[1] and r[1].strip() and r[0] != 203]
    assert Counter((r[0], r[1], r[2], r[3]) for r in got if r[0] != 203 and (r[1] or "").strip()) == Counter((r[0], r[1], r[2], r[3]) for r in want)
    assert not [r for r in got if not r[1]]


def test_line_stage_equals_brute_force(spark, docs):
    got = Counter(rows_of(corpus_pipeline.drop_common_lines(spark, docs, "")))
    sites = {}
    for _, t, _, s, _ in corpus():
        for line in (t or "").split("\n"):
            sites.setdefault(line.replace("\t", " ").replace("\r", " ").strip(" "), set()).add(s)
    common = {x for x, s in sites.items() if x and len(s) >= 10}
    assert common == {"All rights reserved"}
    want = Counter()
    for i, t, k, s, _ in corpus():
        kept = None if t is None else "\n".join(x for x in t.split("\n") if x.replace("\t", " ").strip(" ") not in common)
        want[(i, kept, k, s, len(kept or ""))] += 1
    assert got == want


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs):
    got = rows_of(corpus_pipeline.drop_near_duplicates(spark, docs, ""))
    root = near_groups([(r[0], r[1]) for r in corpus() if r[0] is not None])
    assert sorted(r[0] for r in got if r[0] is not None) == sorted(i for i, c in root.items() if i == c)
    assert len(root) > len(set(root.values())) > 50
    assert Counter(r for r in got if r[0] is None) == Counter(r for r in corpus() if r[0] is None)
    assert [r for r in got if r[0] == 5] == [min(r for r in corpus() if r[0] == 5)]


def test_mix_stage_equals_the_sql_of_the_mix(spark, docs):
    got = Counter(rows_of(corpus_pipeline.mix_sources(spark, docs, "")))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", corpus())
    taken = con.sql(queries.MIX_SQL).select("doc_id", "size", "taken").fetchall()
    times = Counter()
    for i, size, t in taken:
        times[i, size] += t // size if size else 1
    have = Counter()
    for (i, text, *_), n in got.items():
        have[i, len((text or "").split())] += n
    assert have == Counter({k: n for k, n in times.items() if n})
    assert {r[:4] for r in got} <= {r[:4] for r in corpus()}


def test_last_stage_encodes_as_the_library_and_decodes(spark, docs):
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.ranks_of(bpe.default_ranks()), special_tokens={})
    got = Counter((r.doc_id, r.source, r.lang, tuple(r.ids), r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.encode(spark, docs, "").collect())
    want = Counter()
    for i, t, k, s, _ in corpus():
        ids = lib.encode_ordinary(t or "")
        want[i, s, k, tuple(ids), len(ids), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want


def test_run_is_the_stages_in_turn_and_takes_empty_tables(spark, docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_dedup", "mix_sources", "byte_bpe"]
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    x = docs
    for _, stage in corpus_pipeline.STAGES:
        x = stage(spark, x, "")
    key = ["doc_id", "n_tokens", "decoded_sha256"]
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path / "a")).select(*key).collect())) == Counter(map(tuple, x.select(*key).collect()))
    docs.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
