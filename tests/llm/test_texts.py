import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from common import ODD, documents, prose
from pyspark.sql import functions as F

from fieldcheck.llm import bpe, chat, contamination, queries, records, secrets, spans, vocabulary
from fieldcheck.llm.scratch import Scratch
from fieldcheck.llm.shingles import word_hashes

SMALL = "/root/testdata/sf0.001"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def agrees(spark, sql, got, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        at = df.toArrow()
        con.register(name, at)
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    tables = {t: spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark", "conversations", "embeddings")}
    agrees(spark, queries.ORACLE_SQL[name], queries.QUERIES[name](spark, SMALL), **tables)


# chat formatting


TURNS = "conv_id long, turn long, role string, text string, formatted string"


def test_chat_reads_back_whatever_the_texts(spark):
    rng = random.Random(1)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[ROLE]", "[TEXT]", "[/ROLE]", "<", "[", "\\", "/", "s>", "INST]", "a", "\n", "$1", "<\\s>", "[\\\\INST]"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "x[TEXT]<s>", "", None]), "".join(rng.choices(bits, k=rng.randint(0, 8)))) for c in range(60) for t in range(5)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], TURNS)
    out = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in out.withColumn("read", chat.read_turns(F.col("formatted"))).collect()}
    for c in range(60):
        own = [(r[2] or "", r[3]) for r in rows if r[0] == c]
        assert [tuple(t) for t in got[c]["read"]] == own
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]
    plain = out.select(F.explode("segments").alias("s")).where("s.loss").select(chat.unescaped(F.col("s.text"))).collect()
    assert sorted(r[0] for r in plain) == sorted(r[3] for r in rows if r[2] == "assistant")


def test_chat_states(spark):
    cases = {1: "user assistant", 2: "system user assistant", 3: "user", 4: "assistant user", 5: "user user assistant", 6: "user assistant user assistant", 7: "user tool assistant", 8: "system"}
    rows = [(c, t, r, "x", "") for c, rs in cases.items() for t, r in enumerate(rs.split())]
    got = {r["conv_id"]: (r["valid"], r["first_bad_turn"]) for r in chat.format_conversations(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, None), 4: (False, 0), 5: (False, 1), 6: (True, None), 7: (False, 1), 8: (False, None)}


def test_chat_nulls_ties_and_no_rows(spark):
    rows = [(None, None, None, None, ""), (None, 1, "user", None, ""), (5, 1, "user", "b", ""), (5, 1, "user", "a", ""), (5, 1, "user", "a", ""), (5, None, "user", "z", "")]
    out = chat.format_conversations(spark.createDataFrame(rows, TURNS)).withColumn("read", chat.read_turns(F.col("formatted")))
    got = {r["conv_id"]: [tuple(t) for t in r["read"]] for r in out.collect()}
    assert got == {None: [("", ""), ("user", "")], 5: [("user", "z"), ("user", "a"), ("user", "a"), ("user", "b")]}
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).collect() == []


# benchmark decontamination


def brute_hits(text, items, size):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    words = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text)))
    flat, hit, found = [m.group() for m in words], [False] * len(words), set()
    for item, t in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        for k in range(max(1, len(own) - size + 1)):
            w = own[k : k + size]
            for i in range(len(flat) - len(w) + 1) if w else ():
                if flat[i : i + len(w)] == w:
                    found.add(str(item))
                    hit[i : i + len(w)] = [True] * len(w)
    stretches = []
    for k, m in enumerate(words):
        if hit[k]:
            if k and hit[k - 1]:
                stretches[-1] = (stretches[-1][0], m.end())
            else:
                stretches.append((m.start(), m.end()))
    return len(words), sum(hit), sorted(found), stretches


@pytest.mark.parametrize(("chars", "most"), [(4_000_000, 4), (30, 1000), (30, 0)])
def test_contamination_against_brute_force(spark, monkeypatch, chars, most):
    """One automaton, many of them, and a benchmark that is too large for them."""
    monkeypatch.setattr(contamination, "AUTOMATON_CHARS", chars)
    monkeypatch.setattr(contamination, "AUTOMATA", most)
    rng = random.Random(3)
    words = ["ä", "b", "C1", "déf", "漢"]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for k in range(30)] + [(31, None), (32, "..."), (4, "b b, B"), (None, "c1 c1 c1 c1 b"), (4, "b b, B")]
    texts = [*ODD, *(" ".join(w + rng.choice(["", ",", " -"]) for w in rng.choices(words, k=rng.randint(1, 60))) for _ in range(80))]
    docs = documents(spark, texts).withColumn("n_hit", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in contamination.contaminated(docs, bench, 4).collect()}
    named = [("null" if i is None else i, t) for i, t in items]
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["hit_items"], [tuple(s) for s in r["hit_spans"]]) == brute_hits(t, named, 4)
    assert all(r["n_hit"] == 0 for r in contamination.contaminated(docs, bench.where("false"), 4).collect())
    assert contamination.contaminated(docs.where("false"), bench, 4).count() == 0


@pytest.mark.parametrize("size", [1, 2, 5, 10])
def test_windows_of_all_sizes(size):
    rng = random.Random(size)
    for _ in range(150):
        words = [f"w{k}" for k in range(rng.choice([2, 4, 30]))]
        items = [(str(k), " ".join(rng.choices(words, k=rng.randint(0, 25)))) for k in range(rng.randint(0, 6))]
        own = rng.choice(items)[1].split() if items else []
        text = " ".join([*rng.choices(words, k=rng.randint(0, 9)), *own[rng.randint(0, 5) : rng.randint(5, 25)], *rng.choices(words, k=rng.randint(0, 20))])
        hits, seen = contamination.Windows(tuple(items), size).find(contamination.words_of(text))
        n, n_hit, found, spans_ = brute_hits(text, items, size)
        assert (n_hit, spans_) == contamination.marked_words(text, n, hits) and sorted(seen) == found


def test_a_benchmark_of_four_million_characters_takes_little_memory():
    import subprocess
    import sys
    from pathlib import Path

    code = """
import random, resource
from fieldcheck.llm import contamination
rng = random.Random(1)
words = [f"word{rng.randrange(60000)}" for _ in range(460_000)]
items = tuple((str(k), " ".join(words[k : k + 100])) for k in range(0, len(words), 100))
assert sum(len(t) for _, t in items) > 4_000_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
w = contamination.Windows(items, 10)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, len(w.find(contamination.words_of(items[7][1]))[0]))
"""
    root = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env={**__import__("os").environ, "PYTHONPATH": root}, capture_output=True, text=True, check=True)
    mb, found = map(int, out.stdout.split())
    assert mb < 200 and found == 91


# secrets


def test_secrets_against_sql_and_python(spark):
    hexa, access = "0123456789abcdef" * 3, "AKIA" + "ABCDEFGH12345678"
    texts = [
        *ODD, f"password = {hexa}", f"PassWD:'{hexa}' {access}", "secret=token:abcdefgh12 token=short api_key = 'abcd.efgh'", f"é漢 token = \"{hexa}\" x {hexa}é{hexa[:31]}",
        "AKIAKIA AKIASHORT", f"{access}{access}", "passwords: nothing", "apikey:=x", "x" * 3000 + f" token={hexa} " + "y" * 3000, "aB3dE6gH9jK2mN5pQ8sT1vW4yZ", f"token= {hexa} aB3dE6gH9jK2mN5pQ8sT1vW4yZ", "Zz9Zz9Zz9Zz9Zz9Zz9Zz9Zz9Zz9",
        "token=abcdefgh1 " * 300,
    ]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.where("doc_id > 15")).withColumn("owner", F.lit("clash")).withColumn("source", F.when(F.col("doc_id") % 4 > 0, F.col("source")))
    base = [(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "assign"), ("AKIA[A-Z0-9]+", "access"), ("[0-9a-f]+", "hex")]
    least = {"assign": 8, "access": 16, "hex": 32}
    got = secrets.secret_spans(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        want = sorted((m.start(), k, m.end()) for k, (p, name) in enumerate(base) for m in re.finditer(p, texts[r["doc_id"]] or "") if len(m.group(2) if name == "assign" else m.group()) >= least[name])
        assert [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] < 3] == want
    listed = secrets._listed(F.col("spans"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    out = secrets.secret_spans(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets._listed(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), listed.alias("spans"), F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )
    agrees(spark, secrets.OP5_SQL, out, documents=docs.select("doc_id", "text", "lang", "source"))


def test_ownership_tells_examples_from_live_values(spark):
    shared, own = "token=examplevalue1", "token=onlymine1"
    run = "aB3dE6gH9jK2mN5pQ8sT1vW4yZ"
    texts = [shared] * 4 + [own] * 4 + [run, f"{run}7", f"{run}7"]
    docs = documents(spark, texts, {k: f"o{k}" for k in range(4)} | {k: "o1" for k in range(4, 8)} | {8: "o1", 9: "o1", 10: "o2"})
    got = {r["doc_id"]: [(s["kind"], s["live"]) for s in r["spans"]] for r in secrets.secret_spans(docs).collect()}
    assert [got[k] for k in range(4)] == [[(0, False)]] * 4 and [got[k] for k in range(4, 8)] == [[(0, True)]] * 4
    assert got[8] == [(3, True)] and got[9] == got[10] == []
    clean = {r["doc_id"]: r["text"] for r in secrets.masked(docs, "#").collect()}
    assert clean[0] == shared and clean[5] == "#" and clean[8] == "#"


def test_masking_keeps_rows_columns_and_other_text(spark):
    texts = [*ODD, "é token=abcdefgh1, secret: 'abcdefgh2' end", "token=" + "0123456789abcdef" * 2 + "zz é"]
    docs = documents(spark, texts).withColumn("_live", F.lit(1))
    docs = docs.unionByName(docs)
    out = secrets.masked(docs.drop("_live"), "*")
    got = sorted((r["doc_id"], r["text"] or "") for r in out.collect())
    want = {len(ODD): "é *, *' end", len(ODD) + 1: "* é"}
    assert got == sorted((k, want.get(k, t) or "") for k, t in enumerate(texts) for _ in (0, 1))


def test_secret_plan_has_no_python(spark):
    plan = secrets.secret_spans(documents(spark, ["token=abcdefgh1"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


# token ids


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary.default_path())


def odd_texts():
    rng = random.Random(7)
    bits = ["a", "b", " ", "  ", "\n", "\t", "'s", "'t", "é", "ß.", "漢", "\U0001f600", "<|endoftext|>", "　", " ", "\x85", "\x1c", "​", "1", "23", ".", ",", "!", "the", "tion", "\x00", " ", "-"]
    return [*(t or "" for t in ODD), " ", "  a", "a ", "x" * 500, " the" * 300, *("".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(1500))]


def test_codecs_agree_with_the_library(library, monkeypatch):
    texts = odd_texts()
    content = open(vocabulary.default_path(), encoding="utf-8").read()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for remembered in (200_000, 20):
        monkeypatch.setattr(bpe, "REMEMBERED", remembered)
        monkeypatch.setattr(records, "REMEMBERED", remembered)
        own, pieced = bpe.Codec(content), records.Encoder(content)
        assert [own.encode(t) for t in texts] == want
        for some in (texts, texts[::-1]):
            assert [x.tolist() for x in pieced.encode(some)] == (want if some is texts else want[::-1])
    assert [own.decode(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]
    assert own.decode([128, 250]) == library.decode([128, 250], skip_special_tokens=False)


def test_pieces_join_to_the_text():
    seen = []

    def encode(pieces):
        seen.append(pieces)
        return [np.array([k], "<u4").tobytes() for k in range(len(pieces))]

    column = pa.array([None, *odd_texts()])
    rows = list(vocabulary.encode_column(column, encode))
    assert [b"".join(seen[0][k] for k in row) for row in rows] == [(t or "").encode() for t in column.to_pylist()]
    assert len(set(seen[0])) == len(seen[0])


def test_bpe_operator(spark, library):
    texts = odd_texts()[:80] + [None]
    docs = documents(spark, texts).withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: r for r in bpe.encoded(docs).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = got[k]
        assert (r["ids"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (ids, len(ids), sha(",".join(map(str, ids))), sha(t or ""))
    assert bpe.encoded(docs.where("false")).count() == 0


def manifest(spark, docs, folder, **options):
    content = spark.sparkContext.broadcast(open(vocabulary.default_path(), encoding="utf-8").read())
    return Scratch(spark, "manifest").table(records.write_records(docs, f"file://{folder}", content, **options), "files")


@pytest.mark.parametrize("compress", [True, False])
def test_records_round_trip(spark, library, tmp_path, compress):
    texts = odd_texts()[:150]
    docs = documents(spark, texts).withColumn("start", F.lit(1)).repartition(3)
    docs = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long")))
    files = manifest(spark, docs, tmp_path, compress=compress)
    rows = [(None, texts[8])] + sorted([(k, t) for k, t in enumerate(texts)] + [(3, texts[3])])
    want, at = [], 0
    for k, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted((tuple(r) for r in records.read_records(files).collect()), key=lambda r: r[1])
    assert got == want
    path = files.where("docs > 0").first()["path"]
    for offset, _, doc, n in random.Random(1).sample(records.read_index(path), 5):
        found, ids = records.read_at(path, offset)
        assert found == doc and len(ids) == n


def test_records_find_damage(spark, tmp_path):
    path = manifest(spark, documents(spark, ["some words here"]), tmp_path).first()["path"].removeprefix("file://") + ".rec"
    data = bytearray(open(path, "rb").read())
    import io

    for at in (0, 9, 14, len(data) - 2):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.read_record(io.BytesIO(bytes(bad)))
    with pytest.raises(ValueError):
        records.read_record(io.BytesIO(bytes(data[:5])))


def test_reading_goes_by_the_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "CHUNK", 2000)
    rng = random.Random(2)
    rows = manifest(spark, documents(spark, [prose(rng, rng.randrange(1, 200)) for _ in range(60)]), tmp_path).collect()
    path = max(rows, key=lambda r: r["docs"])["path"]
    found = list(records.shuffled(path))
    assert [n for n, *_ in found] != sorted(n for n, *_ in found) == list(range(len(found)))
    for n, doc_id, ids in found:
        offset, _, doc, n_ids = records.read_index(path)[n]
        assert (doc, n_ids) == (doc_id, len(ids)) and (records.read_at(path, offset)[1] == ids).all()
    file = path.removeprefix("file:") + ".idx"
    good = open(file, "rb").read()
    for wrong in (good[:16] + good[44:52] + good[24:], good[:28] + good[:8] + good[36:]):  # the document of another entry, and the place of another one
        open(file, "wb").write(wrong)
        with pytest.raises(ValueError):
            list(records.shuffled(path))
    open(file, "wb").write(good)
    assert len(list(records.shuffled(path))) == len(found)


def test_records_of_nothing(spark, tmp_path):
    assert records.read_records(manifest(spark, documents(spark, ["x"]).where("false"), tmp_path)).count() == 0


def test_wide_ids():
    ids = np.array([1, 70_000], "<u4")
    assert records.unpacked(records.payload(-5, ids, None))[1].tolist() == [1, 70_000]
    assert records.unpacked(records.payload(None, ids, None))[0] == records.NO_ID


# repeated passages


def sentences(text):
    data = (text or "").encode()
    words = [(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", data)]
    out, now = [], []
    for k, (at, w) in enumerate(words):
        now.append((at, w))
        behind = data[at + len(w) : words[k + 1][0]] if k + 1 < len(words) else b""
        if k + 1 == len(words) or b"\n" in behind or w[-1:] in b".!?" or (w[-1:] in b"\"')]" and len(w) > 1 and w[-2:-1] in b".!?"):
            out.append(now)
            now = []
    cut = []
    for s in out:
        now = []
        hashes = word_hashes(pa.array([w.decode() for _, w in s]))[0] if len(s) > spans.LONG else [1] * len(s)
        for x, h in zip(s, hashes, strict=True):
            now.append(x)
            if int(h) % spans.CUT == 0 or x is s[-1]:
                cut.append(now)
                now = []
    return data, cut


def without_repeats(texts):
    seen, out = set(), []
    for t in texts:
        data, own = sentences(t)
        gone = set()
        for i in range(len(own)):
            j = i + spans.SENTENCES
            while j <= len(own) and sum(map(len, own[i:j])) < spans.WORDS:
                j += 1
            if j <= len(own):
                run = tuple(w.lower() for s in own[i:j] for _, w in s)
                if run in seen:
                    gone.update(range(i, j))
                seen.add(run)
        edge = [0, *(s[0][0] for s in own[1:]), len(data)]
        kept = b"".join(data[a:b] for k, (a, b) in enumerate(zip(edge, edge[1:], strict=False)) if k not in gone).decode()
        out.append((len(own), len(gone), t if not gone else kept))
    return out


def test_repeated_passages_against_brute_force(spark):
    rng = random.Random(9)
    passage = "Some words that stand together. In more than one place! And (so they do.) They go on for quite a while; it is a longer one without any stop at all in it here. Done now. Really done."
    plain = "word " * 3 + " ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"]) + str(rng.randrange(50)) for _ in range(60))
    texts = [*ODD, passage, f"é First. {passage.upper()}  Last one.\nEnd", prose(rng, 200), f"{prose(rng, 40)}\n{passage}\n{passage}\n{prose(rng, 30)}", f"{prose(rng, 9)} {plain} {prose(rng, 9)}", f"{prose(rng, 20)} {plain}", passage]
    docs = documents(spark, texts).withColumns({"known": F.lit("clash"), "doc": F.lit(2)})
    out = spans.without_repeats(docs)
    got = {r["doc_id"]: (r["n_sentences"], r["n_removed"], r["text"]) for r in out.collect()}
    want = without_repeats(texts)
    assert got == dict(enumerate(want)) and sum(n > 0 for _, n, _ in want) == 4
    assert set(out.columns) == {*docs.columns, "n_sentences", "n_removed", "words_removed"} - {"known"}


def test_repeats_of_one_document_and_nothing(spark):
    text = "One two three. Four five six. Seven eight nine. Ten eleven twelve thirteen."
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (0, "x"), (2, f"{text} {text} End of it."), (2, text + " More.")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_removed"]) for r in spans.without_repeats(df).collect()), key=repr)
    assert got == sorted([(None, 0), (0, 0), (1, 4), (1, 4), (2, 8), (2, 4)], key=repr)
    one = spark.createDataFrame([(2, f"{text} {text} End of it."), (2, text + " More.")], "doc_id long, text string")
    # whichever of the two comes first by its hash: each sentence of the passage stays once
    assert sorted(r["n_removed"] for r in spans.without_repeats(one).collect()) in ([0, 8], [4, 4])
    assert spans.without_repeats(df.where("false")).count() == 0


def common_runs(one, other):
    """Whether the two texts have an equal run."""
    row, _, _, h, check = spans.runs(pa.array([one, other]))
    both = [set(zip(h[row == k].tolist(), check[row == k].tolist(), strict=True)) for k in (0, 1)]
    return bool(both[0] & both[1])


@pytest.mark.parametrize("stops", [0, 0.02, 0.08, 0.3])
@pytest.mark.parametrize("distinct", [1, 2, 3, 30, 5000])
def test_every_passage_of_fifty_words_has_a_run_whatever_surrounds_it(stops, distinct):
    rng = random.Random(distinct)
    names = [f"w{rng.randrange(10**9)}" for _ in range(distinct)]
    some = lambda n, other="": [other + rng.choice(names) + ("." if rng.random() < stops else "") for _ in range(n)]
    for _ in range(300):
        passage = some(50)
        around = [" ".join([*some(rng.randrange(40), o), *passage, *some(rng.randrange(40), o)]) for o in ("a", "b")]
        assert common_runs(*around)


def test_runs_of_a_row_do_not_hang_on_its_neighbours():
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(12, 40)).replace(".", "") for _ in range(300)] + [prose(rng, 30) for _ in range(100)]
    rng.shuffle(texts)
    row, _, _, h, _ = spans.runs(pa.array(texts))
    assert all(h[row == k].tolist() == spans.runs(pa.array([t]))[3].tolist() for k, t in enumerate(texts))


def test_stopless_passage_is_removed(spark):
    rng = random.Random(3)
    low = [w for w in (f"v{k}" for k in range(3000)) if int(word_hashes(pa.array([w]))[0][0]) % spans.CUT]
    passage = " ".join(rng.choice(low) for _ in range(51))
    texts = [f"before it {passage} behind it", f"{passage}", f"some other words {passage}", "word " * 60, "word " * 60]
    got = {r["doc_id"]: r for r in spans.without_repeats(documents(spark, texts)).collect()}
    assert got[0]["text"] == texts[0] and got[0]["words_removed"] == got[0]["n_removed"] == 0
    assert all(got[k]["words_removed"] >= 12 and got[k]["n_removed"] >= 1 for k in (1, 2, 4))
    assert all(len(got[k]["text"].split()) + got[k]["words_removed"] == len(texts[k].split()) for k in got)


def test_rows_without_an_id_are_documents_of_their_own(spark):
    text = "One two three. Four five six. Seven eight nine. Ten eleven twelve thirteen."
    rows = [(None, text), (None, text), (None, f"Before it. {text} Behind it."), (None, "x"), (None, None), (-5, f"{text} More."), (7, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["n_removed"], r["words_removed"]) for r in spans.without_repeats(df).collect()]
    assert len(got) == len(rows) and sorted(n for _, n, _ in got) == [0, 0, 0, 4, 4, 4, 4]
    assert sum(w for _, _, w in got) == 4 * 13 and all(n == 4 for d, n, _ in got if d is not None)


def test_rows_of_one_document(spark):
    """Different texts, and equal ones, under one doc_id: what they share stays once, and other documents lose it."""
    rng = random.Random(12)
    shared, other = prose(rng, 60), prose(rng, 60)
    texts = [f"{prose(rng, 30)} {shared} {prose(rng, 30)}", f"{shared} {prose(rng, 30)}", f"{prose(rng, 25)} {shared}"]
    rows = [(2, t) for t in texts] + [(2, texts[0]), (3, other), (3, other), (9, f"{shared} {other}"), (None, "alone")]
    found = spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    left = [(r["doc_id"], r["text"]) for r in found]
    middle = lambda text: " ".join(text.split()[15:-15])
    assert sum(middle(shared) in t for _, t in left) == 1 and sum(middle(other) in t for _, t in left) == 1
    assert next(d for d, t in left if middle(shared) in t) == 2 and next(d for d, t in left if middle(other) in t) == 3
    assert sum(r["words_removed"] == 0 for r in found) == 3


# the whole rule, with nothing of the module but its numbers

M = (1 << 64) - 1


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def word_hash(word):
    letters = [b + 32 if 65 <= b <= 90 else b for b in word]
    return mix(sum(mix((b + 1) * 0x9E3779B97F4A7C15 & M) * ((mix((1001 + (i & 1023)) * 0x9E3779B97F4A7C15 & M) | 1) + (i >> 10 << 1)) for i, b in enumerate(letters)) & M)


def plain_units(text):
    """Bytes, and units of (first byte, words, hashes, begins a sentence)."""
    data = (text or "").encode()
    words = [(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", data)]
    out, now = [], []
    for k, (at, w) in enumerate(words):
        now.append((at, w, word_hash(w)))
        behind = data[at + len(w) : words[k + 1][0]] if k + 1 < len(words) else b""
        if k + 1 == len(words) or b"\n" in behind or w[-1:] in b".!?" or (w[-1:] in b"\"')]" and len(w) > 1 and w[-2:-1] in b".!?"):
            out.append(now)
            now = []
    units = []
    for sentence in out:
        if len(sentence) <= 12:
            units.append((sentence, True))
            continue
        parts, now = [], []
        for x in sentence:
            now.append(x)
            if x[2] % 6 == 0:
                parts.append(now)
                now = []
        for part in [*parts, now] if now else parts:
            cuts = set()
            for i in range(len(part) - 11):
                least = min(x[2] for x in part[i : i + 12])
                cuts.add(max(j for j in range(i, i + 12) if part[j][2] == least))
            begin = 0
            for c in sorted(cuts | {len(part) - 1}):
                units.append((part[begin : c + 1], begin == 0))
                begin = c + 1
    return data, units


def shortest(sizes):
    """(i, j) of the shortest run of three items and twelve words from each item on."""
    out = []
    for i in range(len(sizes)):
        j = i + 3
        while j <= len(sizes) and sum(sizes[i:j]) < 12:
            j += 1
        if j <= len(sizes):
            out.append((i, j))
    return out


def plain_runs(units):
    begin = [k for k, (_, w) in enumerate(units) if w]
    edge = [*begin, len(units)]
    size = [len(words) for words, _ in units]
    coarse = [(edge[i], edge[j]) for i, j in shortest([sum(size[a:b]) for a, b in zip(edge, edge[1:], strict=False)])]
    chosen = set(coarse)
    for i, j in shortest(size):
        following = [run for run in coarse if run[0] >= i]
        if not following or sum(size[i : following[0][1]]) > 25:
            chosen.add((i, j))
    return sorted(chosen)


def plain_repeats(rows):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data, units = plain_units(text)
        gone, own = set(), set()
        for i, j in plain_runs(units):
            run = tuple(w.lower() for words, _ in units[i:j] for _, w, _ in words)
            if run in seen or run in own:
                gone.update(range(i, j))
            own.add(run)
        seen |= own
        begin = [k for k, (_, w) in enumerate(units) if w]
        lost = sum(any(k in gone for k in range(a, b)) for a, b in zip(begin, [*begin[1:], len(units)], strict=False))
        edge = [0, *(words[0][0] for words, _ in units[1:]), len(data)]
        kept = b"".join(data[a:b] for k, (a, b) in enumerate(zip(edge, edge[1:], strict=False)) if k not in gone).decode()
        out[doc] = (len(begin), lost, sum(len(units[k][0]) for k in gone), kept if gone else text)
    return out


@pytest.mark.parametrize("stops", [0, 0.05, 0.25])
def test_the_whole_rule_against_brute_force(spark, stops):
    rng = random.Random(int(stops * 100))
    names = [f"{rng.choice(['x', 'Yy', 'zé'])}{k}" for k in range(400)] + ["same"]
    some = lambda n: " ".join(rng.choice(names) + (rng.choice([".", "?", '."']) if rng.random() < stops else "") + ("\n" if rng.random() < stops / 5 else "") for _ in range(n))
    passages = [some(n) for n in (13, 20, 51, 51, 90, 200)] + ["same " * 40]
    texts = [*ODD, *passages]
    texts += [f"{some(rng.randrange(40))} {rng.choice(passages)} {some(rng.randrange(40))} {rng.choice(passages)} {some(rng.randrange(9))}" for _ in range(60)]
    got = {r["doc_id"]: (r["n_sentences"], r["n_removed"], r["words_removed"], r["text"]) for r in spans.without_repeats(documents(spark, texts)).collect()}
    want = plain_repeats(list(enumerate(texts)))
    assert got == want and sum(w[2] > 0 for w in want.values()) > 40
