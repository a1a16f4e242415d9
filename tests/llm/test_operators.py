import base64
import hashlib
import random
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pytest

from kindred.llm import ann, bpe, common, embedding_dedup, language_id, line_dedup, minhash_dedup, mixing, queries, substring_dedup, token_counts, warc

DOC = "doc_id long, text string, source string, bands string, id string"
ODD = [(1, None, None, "x", "y"), (2, "", "a", "x", "y"), (3, "word", "a", None, "y"), (3, "word", "a", None, "y"), (None, "null id", "b", "x", None), (4, " \t\n ", "b", "x", "y"), (5, "long " * 30000, "b", "x", "y")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


def encoder():
    return bpe.Encoder(bpe.table_of(bpe.default_ranks()), bpe.default_pattern(), True)


def test_encoding_matches_the_library_and_decodes(spark, odd):
    import tiktoken

    c, pool = encoder(), bpe.Pool(bpe.ranks_of(bpe.default_ranks()))
    lib = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["".join(rng.choice(" \n\tabé'sçLL19.,  ß") for _ in range(rng.randint(0, 80))) for _ in range(500)] + ["a" * 2000, "  x  ", "<|endoftext|>"]
    for bound in (1 << 30, 20_000):  # the second forgets all the time
        c.tokens.bound = c.first.bound = c.later.bound = bound
        for t in texts:
            ids = np.frombuffer(c.encode(t), "<i4")
            assert ids.tolist() == lib.encode_ordinary(t)
            assert pool.decode(ids).tobytes() == t.encode()
    rows = bpe.decode(bpe.encode(odd, id_cols=("doc_id", "bands"))).collect()
    assert sorted(r.decoded.decode() for r in rows) == sorted(t or "" for _, t, *_ in ODD)
    assert sorted(r.decoded.decode() for r in bpe.encode(odd, decoded=True).collect()) == sorted(t or "" for _, t, *_ in ODD)
    with pytest.raises(ValueError):
        pool.decode(np.array([10**6]))


def test_other_patterns_see_whole_texts(spark):
    rows = [(1, "two words here"), (2, None)]
    got = bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), pattern=r"(?s).+")).collect()
    want = encoder().merge(b"two words here")
    assert {r.doc_id: list(r.ids) for r in got} == {1: want, 2: []}


def test_decoding_keeps_null_ids_and_replaces_a_column_of_its_name(spark):
    df = spark.createDataFrame([(1, None, "old"), (2, [], "old")], "k int, ids array<int>, decoded string")
    assert {r.k: r.decoded for r in bpe.decode(df).collect()} == {1: None, 2: b""}
    assert bpe.decode(bpe.encode(spark.createDataFrame([], DOC))).count() == 0


def test_perfect_hash_fills_every_slot():
    table = bpe.PerfectHash([str(i).encode() for i in range(5000)])
    assert sorted(table.slot_of) == list(range(5000))
    assert all(table.slot(str(i).encode()) == table.slot_of[i] for i in range(5000))


def test_token_counts_of_chunks_and_words_match_whole_texts(spark, odd):
    c = token_counts.counting(token_counts.default_vocabulary())
    rng = random.Random(6)
    texts = ["".join(rng.choice([" ", "  ", "ab", "don't", "\n", "é9", "<|endoftext|>", ",.", "x" * 30]) for _ in range(rng.randint(0, 90))) for _ in range(300)]
    want = c.many(texts)
    assert c.counts(texts) == want
    assert [c.huge(t, 50, 6) for t in texts] == want
    assert c.chunks and c.gaps
    got = token_counts.count_tokens(odd).collect()
    assert sorted(r.n_bytes for r in got) == sorted(len((t or "").encode()) for _, t, *_ in ODD)
    assert sum(r.over_limit for r in got) == 1
    assert token_counts.count_tokens(odd.limit(0)).count() == 0


def test_a_small_memo_and_other_vocabularies_count_right(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(16)
    texts = [" ".join(rng.choice("ab c dé Ff 12 ß中 x--y".split()) + str(rng.randrange(50)) for _ in range(40)) for _ in range(50)]
    c = token_counts.Counting(token_counts.default_vocabulary())
    want = c.many(texts)
    monkeypatch.setattr(token_counts, "MEMO_BYTES", 3000)
    assert [n for k in range(0, 50, 5) for n in c.counts(texts[k : k + 5])] == want
    other = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(other)
    t = " ".join(texts) + "  Straße  A"
    got = token_counts.count_tokens(spark.createDataFrame([(1, t)], "doc_id long, text string"), vocabulary=other, chunk=100, overlap=10).first()
    assert got.n_tokens == len(lib.encode(t, add_special_tokens=False))


def test_mix_keeps_targets_and_caps(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert r.taken <= 3 * r.size and r.target <= 3 * r.source_size
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd).collect()))
    assert mixing.mix(odd.limit(0)).count() == 0
    kept = [tuple(r) for r in mixing.mix(odd, keep=("text", "bands")).select("text", "bands").collect()]
    assert sorted(map(str, kept)) == sorted(str((t, x)) for _, t, _, x, _ in ODD)
    many = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(900)], "doc_id long, text string, source string")
    by = {}
    for r in mixing.mix(many).collect():
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= 7 for t, n in by.values())


def test_common_lines_go_and_rows_stay(spark, odd):
    docs = spark.createDataFrame([(i, f"own {i}\n Share this \nend {i % 2}", f"s{i % 12}", 1) for i in range(24)] + [(99, None, None, 1)], "doc_id long, text string, source string, n_lines int")
    out = {r.doc_id: r for r in line_dedup.drop_common_lines(docs, sites=10).collect()}
    assert out[3].text == "own 3\nend 1" and out[3].n_removed == 1 and out[99].text is None
    assert line_dedup.drop_common_lines(odd).count() == len(ODD)
    assert line_dedup.drop_common_lines(odd.limit(0)).count() == 0
    clash = odd.withColumnsRenamed({"bands": "__lines", "id": "__removed"}).withColumn("__t1", odd["doc_id"])
    cleaned = line_dedup.drop_common_lines(clash).collect()
    assert sorted(str((r.text, r["__lines"], r["__removed"], r["__t1"])) for r in cleaned) == sorted(str((t, x, y, i)) for i, t, _, x, y in ODD)


@pytest.mark.parametrize("sites", [8, 9, 10, 11, 12, 13])
def test_sites_are_counted_exactly_near_the_threshold(spark, sites):
    docs = spark.createDataFrame([(i, "shared\nown %d" % i, f"s{i % sites}") for i in range(40)], "doc_id long, text string, source string")
    gone = {r.n_removed for r in line_dedup.drop_common_lines(docs, sites=10).collect()}
    assert gone == ({1} if sites >= 10 else {0})


def posterior(rows, model, strength=20.0):
    """Brute force of the fusion: rows of (text, declared, host)."""
    k = len(model.languages) + 1
    ll, n, vote = [], [], []
    for t, _, _ in rows:
        data = np.frombuffer(f" {t.lower()} ".encode(), np.uint8) if t else np.zeros(0, np.uint8)
        g = language_id.grams(data) if len(data) > 2 else np.zeros(0, np.uint32)
        n.append(len(g))
        ll.append(model.table[g].sum(axis=0, dtype=np.float64) / max(1, len(g)))
        vote.append(int(np.argmax(ll[-1])) if len(g) else None)
    suffix = [h.split(".")[-1] if h and "." in h else None for _, _, h in rows]
    domain = [".".join(h.split(".")[-2:]) if h and h.count(".") > 1 else h for _, _, h in rows]
    levels = {"host": [h for _, _, h in rows], "domain": domain, "declared": [d for _, d, _ in rows], "suffix": suffix}
    prior = np.array([sum(v == x for v in vote) + 1.0 for x in range(k)])
    prior /= prior.sum()
    out = []
    for i in range(len(rows)):
        c = {name: np.array([sum(v == x for j, v in enumerate(vote) if j != i and values[j] == values[i] and values[i] is not None) for x in range(k)], float) for name, values in levels.items()}
        smooth = lambda x, towards: (x + strength * towards) / (x.sum() + strength)
        f = ll[i] * min(n[i], language_id.EVIDENCE) + np.log(smooth(c["host"], smooth(c["domain"], prior)))
        f += np.log(smooth(c["declared"], prior) / prior) + np.log(smooth(c["suffix"], prior) / prior)
        e = np.exp(f - f.max())
        out.append(e / e.sum())
    return out, n


@pytest.mark.parametrize("few", [20_000, 0])
def test_languages_equal_a_brute_force_posterior(spark, odd, monkeypatch, few):
    monkeypatch.setattr(language_id, "FEW_VALUES", few)  # 0: values meet rows by a shuffle
    words = {"en": "the of and with water house", "fr": "le des avec maison été jour", "de": "der und mit haus wasser über", "nl": "het een van huis dag naar"}
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(words[k].split(), k=30)), k) for i, k in enumerate(list(words) * 10)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ("de", "en", "fr", "nl")
    asked = []
    for i in range(60):
        k = rng.choice(list(words))
        text = rng.choice([" ".join(rng.choices(words[k].split(), k=rng.randint(1, 4))), "x", "", None, "qq zz"])
        asked.append((i if i % 9 else None, text, rng.choice([k, k, None]), rng.choice([f"a.b.{k}", f"c.b.{k}", f"www.{k}", "localhost", None])))
    asked += [asked[3]] * 3
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(asked)], "doc_id long, text string, declared string, host string, nr int")
    got = {r.nr: r for r in language_id.identify(df, model, declared=df["declared"], host=df["host"], keep=("nr",)).collect()}
    want, n = posterior([r[1:] for r in asked], model)
    names = [*model.languages, "und"]
    assert len(got) == len(asked)
    for i, p in enumerate(want):
        assert np.allclose(got[i].posterior, p, atol=1e-9)
        if n[i]:
            assert got[i].language == names[int(np.argmax(p))] and got[i].confidence == pytest.approx(p.max())
        else:
            assert (got[i].language, got[i].confidence, got[i].accepted) == ("und", 0.0, False)
    assert language_id.identify(df.limit(0), model).count() == 0
    assert language_id.identify(odd, model, host=odd["source"]).count() == len(ODD)


def test_fit_draws_the_same_rows_again_and_finds_held_out_texts(spark):
    words = {"en": "the of and with water house", "fr": "le des avec maison été jour"}
    rng = random.Random(17)
    rows = [(7, " ".join(rng.choices(words[k].split(), k=12)), k) for k in list(words) * 40] + [(1, None, "en"), (2, "text", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")  # one id for all rows
    a, b = language_id.fit(df, rows=10), language_id.fit(df.repartition(5), rows=10)
    assert (a.table == b.table).all()
    found = language_id.identify(df.where("lang is not null and text is not null"), a, keep=("lang",)).collect()
    assert all(r.lang == r.language and r.accepted for r in found)
    assert language_id.fit(df.limit(0)).languages == ()


def test_web_pages_are_identified_by_markup_and_address(spark):
    from pyspark.sql import functions as F

    t = spark.createDataFrame([('<html class=x lang="DE-at"><script>var a</script><p>Haus</p>', "https://u:p@WWW.Host.de:80/x?y"), ("<p>no tags</p>", "not an address")], "html string, url string")
    r = t.select(language_id.declared_in(F.col("html")), language_id.host_of(F.col("url")), F.trim(language_id.visible(F.col("html")))).collect()
    assert [tuple(x) for x in r] == [("de", "www.host.de", "Haus"), (None, None, "no tags")]


class Markup(HTMLParser):
    """The visible text, with a blank for each tag, and the language that <html> declares."""

    def __init__(self, html):
        super().__init__()
        self.text, self.lang, self.hidden = [], None, False
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        lang = dict(attrs).get("lang") if tag == "html" else None
        self.lang = self.lang or (lang and lang.lower().split("-")[0])
        self.hidden = tag in ("script", "style")
        self.text.append("" if self.hidden else " ")

    def handle_endtag(self, tag):
        self.hidden = False
        self.text.append(" ")

    def handle_comment(self, data):
        self.text.append(" ")

    def handle_data(self, data):
        self.text.append("" if self.hidden else data)


def test_the_query_of_pages_equals_a_brute_force_posterior(spark, tmp_path):
    words = {"en": "the of and with water house", "fr": "le des avec maison été jour", "de": "der und mit haus wasser über"}
    rng = random.Random(23)
    docs = [(i, " ".join(rng.choices(words[k].split(), k=30)), k) for i, k in enumerate(list(words) * 10)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    pages = []
    for i in range(80):
        k = rng.choice(list(words))
        body = " ".join(rng.choices(words[k].split(), k=rng.randint(0, 5)))
        head = rng.choice([f'<html lang="{k}">', f"<HTML class=a lang={k.upper()}-XX>", "<html>", ""])
        html = f"{head}<style>p {{ the of }}</style><p>{body}</p><!-- le des --><script>var der = '<b>'</script>"
        url = rng.choice([f"https://u:p@WWW.a{i % 3}.{k}:80/x?y#z", f"http://a{i % 3}.{k}", f"ftp://b.c.{k}/d.en", "http://localhost/"])
        pages.append((i, url, html))
    pages += [(100, None, pages[0][2]), (101, "no address", ""), (102, "http://a1.fr", None), (103, None, None), (None, *pages[3][1:]), pages[4], pages[4]]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    model = language_id.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    asked = []
    for _, url, html in pages:
        m = Markup(html) if html is not None else None
        asked.append(("".join(m.text) if m else None, m.lang if m else None, urlsplit(url).hostname if url else None))
    want, n = posterior(asked, model)
    names, rows = [*model.languages, "und"], []
    for (page, _, _), p, grams in zip(pages, want, n, strict=True):
        best, sure = (names[int(np.argmax(p))], float(p.max())) if grams else ("und", 0.0)
        rows.append((page if page is not None else -1, best, best != "und" and sure >= 0.3, sure))
    got = [(r.page_id if r.page_id is not None else -1, r.language, r.accepted, r.confidence) for r in queries.QUERIES["pages_language"](spark, str(tmp_path)).collect()]
    assert [r[:3] for r in sorted(got)] == [r[:3] for r in sorted(rows)]
    assert np.allclose([r[3] for r in sorted(got)], [r[3] for r in sorted(rows)], atol=2e-6)
    assert {r[1] for r in rows} >= set(words) and not all(r[2] for r in rows)


def test_warc_round_trip(spark):
    pages = [(5, "http://a", "same\r\n\r\nWARC/1.1"), (2, None, "same\r\n\r\nWARC/1.1"), (3, "u r\nl", None), (9, "x", ""), (7, "z", "é\n")]
    out = {r.page_id: r for r in warc.roundtrip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert (out[5].record_type, out[5].refers_to) == ("revisit", 2) and out[2].record_type == "response"
    assert (out[9].record_type, out[9].refers_to, out[9].payload_bytes) == ("revisit", 3, 0)
    for i, _, h in pages:
        assert out[i].payload_digest == base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
        assert out[i].payload_bytes == len((h or "").encode())


@pytest.mark.parametrize("digests,hot", [(200_000, 20_000), (0, 2)])
def test_archives_are_bounded_by_bytes_and_odd_rows_come_back(spark, monkeypatch, tmp_path, digests, hot):
    monkeypatch.setattr(warc, "CLASSES", (100, 2000))
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    monkeypatch.setattr(warc, "DIGESTS", digests)
    monkeypatch.setattr(warc, "HOT", hot)
    monkeypatch.setattr(common, "HOT", hot)
    rng = random.Random(14)
    bodies = [None, "", "same", "same", "x" * 50_000, "y" * 1500] + ["z" * rng.randint(101, 2000) for _ in range(12)]
    pages = [(i if i % 5 else None, f"http://h/{i}", b, "clash") for i, b in enumerate(bodies + bodies[:6])] + [(3, "http://again", "same", "clash")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload_digest string")
    path = str(tmp_path / "a")
    warc.write_archives(warc.assign_roles(df), path)
    for f in (tmp_path / "a").rglob("*.gz"):
        records = list(warc.records_of(warc.unzipped(f.read_bytes())))
        assert len(records) <= 1 or sum(len(b) for _, b in records) <= 4000 + 200 * len(records)
    got = sorted(str((r.page_id, r.payload_bytes, r.record_type, r.refers_to)) for r in warc.resolve_revisits(warc.read_archives(spark, path)).collect())
    first = {}
    for i, _, b, _ in pages:
        if i is not None:
            first[b or ""] = min(i, first.get(b or "", i))
    several = {b for b in first if sum((x or "") == b for _, _, x, _ in pages) > 1}
    want = [(i, len((b or "").encode()), "revisit" if (b or "") in several and first[b or ""] != i else "response", first[b or ""] if (b or "") in several and first[b or ""] != i else None) for i, _, b, _ in pages]
    assert got == sorted(map(str, want))


def test_an_empty_table_makes_empty_archives(spark):
    assert warc.roundtrip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_passages_match_brute_force(spark, odd):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    docs = []
    for i in range(40):
        a = rng.randint(0, 250)
        mid = base[a : a + rng.randint(20, 150)]
        if rng.random() < 0.5:
            mid[rng.randrange(len(mid))] = "edit"
        docs.append((i, " ".join([f"x{rng.random()}" for _ in range(rng.randint(0, 40))] + mid + [f"y{rng.random()}"])))
    got = {r.doc_id: r for r in substring_dedup.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    first = {}
    for i, t in docs:
        w = t.split()
        gone = set()
        for s in range(len(w) - 49):
            if first.setdefault(tuple(w[s : s + 50]), i) < i:
                gone |= set(range(s, s + 50))
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone))
        assert got[i].kept_text == " ".join(x for k, x in enumerate(w) if k not in gone)
    assert substring_dedup.drop_repeats(odd).count() == len(ODD)
    assert substring_dedup.drop_repeats(odd.limit(0)).count() == 0
    texts = dict(docs)
    for r in substring_dedup.maximal_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        assert r.length >= 50 and r.first < r.doc_id
        assert texts[r.doc_id].split()[r.start : r.start + r.length] == texts[r.first].split()[r.first_start : r.first_start + r.length]


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_under_polynomial_hashes_stay_different(spark):
    a, b = thue_morse(1024)
    rows = [(i, " ".join([f"w{k}" for k in range(49)] + [x])) for i, x in ((1, a), (2, b))]
    got = substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=50).collect()
    assert all(r.n_removed == 0 for r in got)
    got = minhash_dedup.near_duplicates(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2}
    # word runs whose hashes collide at the level of words, in a window of their length
    u, v = (" ".join(x) for x in (a, b))
    got = substring_dedup.drop_repeats(spark.createDataFrame([(1, u), (2, v)], "doc_id long, text string"), window=1024).collect()
    assert all(r.n_removed == 0 for r in got)


def test_frequent_keys_take_the_broadcast_path_with_the_same_rows(spark, monkeypatch):
    passage = " ".join(f"p{k}" for k in range(60))
    docs = [(i, f"a{i} {passage} b{i % 3} c{i}") for i in range(30)] + [(100 + i, passage) for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = [sorted(map(str, substring_dedup.drop_repeats(df).collect()))]
    monkeypatch.setattr(common, "HOT", 5)
    rows.append(sorted(map(str, substring_dedup.drop_repeats(df).collect())))
    assert rows[0] == rows[1] and sum("n_removed=61" in r for r in rows[0]) == 27 and sum("n_removed=60" in r for r in rows[0]) == 12


def test_near_duplicates_match_brute_force(spark, odd):
    rng = random.Random(9)
    docs = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(80)]
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(80)] = f"e{rng.random()}"
            docs.append((len(docs), " ".join(t)))
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(77)} for i, t in docs}
    root = {i: i for i, _ in docs}
    for _ in root:
        for i in root:
            for j in root:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle_words=4).collect()
    assert {r.doc_id: r.component_id for r in got} == root
    assert minhash_dedup.near_duplicates(odd).count() == len(ODD)
    assert minhash_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_vectors_find_links_and_neighbours(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 16))
    x[200:] = x[:100] + rng.normal(size=(100, 16)) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, x[0].tolist()), (401, None), (402, [0.0] * 16), (403, [float("nan")] * 16)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    y = np.concatenate([x, x[:1]])
    ids = [*range(300), 400]
    u = y / np.linalg.norm(y, axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(t).collect()}
    assert sum(got[i].n_links == n for i, n in zip(ids, s.sum(1), strict=True)) >= 298
    assert got[400].component_id == 0 and got[401].n_links == got[402].n_links == got[403].n_links == 0
    q = spark.createDataFrame([(0,), (50,), (401,)], "query_id long")
    found = ann.nearest(t, q).collect()
    assert {r.query_id for r in found} == {0, 50}
    for i in (0, 50):
        d = np.linalg.norm(y - x[i], axis=1)
        best = [ids[k] for k in np.lexsort((ids, d)) if ids[k] != i][:10]
        assert len({r.vec_id for r in found if r.query_id == i} & set(best)) >= 9


def test_large_buckets_equal_brute_force_in_blocks(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(120):  # copies of one text, most of them too far from each other to link
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 4]) for k in range(57)} for _, t in docs]
    root = list(range(120))
    for a in range(120):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = [lo if r == hi else r for r in root]
    assert 1 < len(set(root)) < 120
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for block, meet, pairs in ((1, 8, 2000), (1, 4096, 3)):
        monkeypatch.setattr(minhash_dedup, "BLOCK", block)
        monkeypatch.setattr(minhash_dedup, "MEET", meet)
        monkeypatch.setattr(minhash_dedup, "PAIRS", pairs)
        got = minhash_dedup.near_duplicates(table, shingle_words=4).collect()
        assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))


@pytest.mark.parametrize("far", [1.0, 1e8])
def test_neighbours_of_near_copies_and_beside_an_outlier_are_exact(spark, far):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(500, 16)) * 0.25
    x[250:] = x[0] + rng.normal(size=(250, 16)) * 1e-6
    x[1, 0] *= far
    x = x.astype(np.float32)
    q = spark.createDataFrame([(i,) for i in (2, 40, 300, 420)], "query_id long")
    rows = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), q).collect()
    found = {i: [r.vec_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == i] for i in (2, 40, 300, 420)}
    for i, got in found.items():
        d = np.linalg.norm(x.astype(np.float64) - x[i].astype(np.float64), axis=1)
        assert len(set(got) & set([k for k in np.lexsort((np.arange(500), d)) if k != i][:10])) >= 9


def test_sketches_leave_out_no_linked_pair():
    """Samples of pairs at the threshold: no XOR count is over the bound, and far pairs are mostly left out."""
    rng = np.random.default_rng(15)
    n = minhash_dedup.BANDS * minhash_dedup.ROWS
    bits = np.uint64(minhash_dedup.SKETCH_BITS)

    def flips(similarity, pairs):
        a = rng.integers(0, 1 << 32, (pairs, n), dtype=np.uint64).astype(np.uint32)
        b = np.where(rng.random((pairs, n)) < similarity, a, rng.integers(0, 1 << 32, (pairs, n), dtype=np.uint64).astype(np.uint32))
        x, y = (minhash_dedup.odd_sketches(m, int(bits)).view(np.uint64) for m in (a, b))
        return np.bitwise_count(x ^ y).sum(axis=1)

    assert (flips(0.8, 50_000) <= minhash_dedup.most_flips(80)).all()
    assert (flips(0.3, 2_000) > minhash_dedup.most_flips(80)).mean() > 0.99


def test_a_pair_at_the_threshold_is_linked(spark):
    rng = random.Random(712)
    a = [f"w{rng.randrange(10**6)}" for _ in range(84)]
    b = a[:72] + [f"x{rng.randrange(10**6)}" for _ in range(5)]
    x, y = ({tuple(t[k : k + 4]) for k in range(len(t) - 3)} for t in (a, b))
    assert 100 * len(x & y) >= 80 * len(x | y)
    got = minhash_dedup.near_duplicates(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (2, " ".join(b)), (None, " ".join(a))], "doc_id long, text string"), shingle_words=4)
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in got.collect()) == [("1", 1, True), ("2", 1, False), ("2", 1, False), ("None", None, False)]


def vector_rows(rng):
    x = rng.normal(size=(120, 8))
    x[60:] = x[:60] + rng.normal(size=(60, 8)) * 0.1
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return rows + [(0, x[0].tolist()), (200, x[0].tolist()), (None, x[1].tolist()), (201, None), (202, [0.0] * 8), (203, [float("inf")] * 8), (204, [None] + [1.0] * 7), (205, [])]


@pytest.mark.parametrize("long", [16_384, 5])
def test_vector_links_equal_brute_force(spark, monkeypatch, long):
    monkeypatch.setattr(embedding_dedup, "LONG", long)
    monkeypatch.setattr(embedding_dedup, "SHARED", 2)
    rows = vector_rows(np.random.default_rng(18))
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, n_links string")).collect()
    assert len(got) == len(rows)
    by = {i: np.array(v, float) for i, v in rows if i is not None and i <= 200}
    u = {i: v / np.linalg.norm(v) for i, v in by.items()}
    links = {i: {j for j in u if j != i and u[i] @ u[j] >= 0.9} for i in u}
    root = {i: i for i in u}
    for _ in u:
        for i in u:
            for j in links[i]:
                root[i] = root[j] = min(root[i], root[j])
    for r in got:
        if r.vec_id in u:
            assert (r.n_links, r.component_id, r.kept) == (len(links[r.vec_id]), root[r.vec_id], root[r.vec_id] == r.vec_id)
        else:
            assert r.n_links == 0 and r.component_id == r.vec_id
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_nearest_vectors_with_odd_rows_and_ties(spark):
    rows = vector_rows(np.random.default_rng(19))
    rows += [(300 + k, rows[5][1]) for k in range(15)]  # more copies than ranks
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    q = spark.createDataFrame([(5,), (5,), (17,), (201,), (None,)], "query_id long")
    got = {}
    for r in ann.nearest(df, q).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {5, 17}
    by = {i: np.array(v, float) for i, v in rows if i is not None and (i <= 200 or i >= 300)}
    for i, found in got.items():
        want = sorted((float(np.sqrt(((by[i] - v) ** 2).sum())), j) for j, v in by.items() if j != i)[:10]
        assert [j for _, j, _ in sorted(found)] == [j for _, j in want]
        assert np.allclose([s for *_, s in sorted(found)], [s for s, _ in want])
    assert ann.nearest(df.limit(0), q).count() == 0
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id) for r in ann.nearest(few, spark.createDataFrame([(1,)], "query_id long")).orderBy("rank").collect()] == [(1, 3), (2, 2)]


def test_recall_on_a_table_many_beams_wide(spark):
    rng = np.random.default_rng(20)
    x = rng.normal(size=(4000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    q = spark.range(0, 4000, 200).withColumnRenamed("id", "query_id")
    hit, asked = 0, {}
    for r in ann.nearest(df, q, beam=150).collect():
        asked.setdefault(r.query_id, set()).add(r.vec_id)
    for i, found in asked.items():
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hit += len(found & set(np.argsort(d)[:10].tolist()))
    assert len(asked) == 20 and hit >= 190
