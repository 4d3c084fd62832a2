"""Each operator against a brute-force version or an exact round trip, and on odd input."""

import hashlib
import io
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sarvgrid.llm import bitplanes, components, fertility, graphsearch, langid, mixing, packing, qda, store, substrings, toxicity, triejoin
from sarvgrid.llm.tokens import END_ID, VOCABULARY, Encoder, encoder, public_path
from sarvgrid.llm.words import NumberTable, Words, rolling, shingle_sets

WORDS = "the of alpha beta gamma delta river stone house light over under green quick table seven".split()
ODD = ["", "   ", None, "one", "two words", "\x1c x y \x85", "É é ǅ İstanbul ΑΣ 日本 語 👩‍👧", "<|endoftext|> a<|startoftext|>b", "!!! ### |", "a" * 5000, "line\nline\nline\n\n  \nline"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, seen binary, score string, quality string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "x", "yz"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    passage = prose(rng, 60)
    out = []
    for k in range(120):
        t = prose(rng, rng.randrange(5, 160))
        if k % 4 == 0:
            t += " " + passage + " " + prose(rng, 9)
        out.append(t)
    for k in range(0, 60, 5):  # exact and near copies
        out.append(out[k])
        w = out[k + 1].split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
        out.append(out[k + 1].upper() + "\n")
    return out + ODD


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Columns whose names the operators use themselves, a null doc_id and a repeated row."""
    rows = [(k, t, ["en", "de", None][k % 3], f"src{k % 3}", len(t or ""), b"x", "s", "q") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "a text without an id of seven words", None, None, None, None, None, None), rows[7]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_match_bytes_split(texts):
    w = Words(pa.array(texts))
    assert [[w.vocabulary[i] for i in w.ids[a:b]] for a, b in zip(w.bounds[:-1], w.bounds[1:])] == [(t or "").encode().split() for t in texts]


def test_rolling_is_a_function_of_the_window():
    x = np.random.default_rng(0).integers(0, 3, 400).astype(np.uint64)
    for width in (1, 3, 8, 20):
        h, seen = rolling(x, width), {}
        assert len(h) == 400 - width + 1
        for k, v in enumerate(h.tolist()):
            assert seen.setdefault(v, tuple(x[k : k + width])) == tuple(x[k : k + width])
        assert len(set(h.tolist())) == len({tuple(x[k : k + width]) for k in range(len(h))})


def test_encoder_equals_whole_text(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    own = Encoder()
    ids, bounds = own.encode(pa.array(texts))
    expected = [whole.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == expected
    assert own.lengths(Words(pa.array(texts))).tolist() == [len(x) for x in expected]


def test_encoder_equals_the_library_on_random_texts():
    from tokenizers import Tokenizer

    whole, rng, own = Tokenizer.from_file(public_path("word_bpe_49k.json")), random.Random(3), Encoder()
    pool = [chr(c) for c in (*range(0x20, 0x7F), *range(0xA1, 0x180))] + ["'s", "'LL", "'Re", "'tis", " ", "  ", "\n", "0", "9", "İ", "ſ", "\u0301", "\u2028", "\x1c", "\x85", "\xa0", "日", "👩", "</w>", "<|endoftext|>", "<|", "ǅ"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["".join(chr(rng.randrange(1, 0x2FFF)) for _ in range(20)) for _ in range(500)]
    own.table.size, own.table.keys = 1 << 11, own.table.keys[: 1 << 11]  # so small that it starts afresh now and then
    own.table._clear()
    for a in range(0, len(texts), 100):
        some = texts[a : a + 100]
        ids, bounds = own.encode(pa.array(some))
        assert [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:])] == [whole.encode(t, add_special_tokens=False).ids + [1] for t in some]


def test_numbers_of_words_survive_full_tables():
    rng, made = random.Random(4), []
    table = NumberTable(lambda new: made.append(len(new)) or np.array([[len(w), int(w[1:] or 0)] for w in new]), 2, bits=6)
    for n in (5, 30, 20, 64, 200, 1):  # up to more than the table has places for
        some = [f"w{rng.randrange(300)}" for _ in range(n)]
        words = Words(pa.array([" ".join(some)]))
        assert table.of(words)[words.ids].tolist() == [[len(w), int(w[1:])] for w in some]
    assert table.of(Words(pa.array([], pa.string()))).shape == (0, 2) and sum(made)


@pytest.mark.parametrize("planes,width", [("bits", 16), ("bits", 31), ("bytes", 2), ("bytes", 4)])
def test_planes_round_trip(planes, width):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 300):
        ids = rng.integers(0, 40_000, n).astype(np.uint32)
        assert (bitplanes.from_planes(bitplanes.to_planes(ids, planes, width), planes, n) == ids).all()


def test_file_reads_any_range():
    class Memory(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    rng, out = np.random.default_rng(2), Memory()
    parts = [rng.integers(0, 49_000, n).astype(np.uint32) for n in (5, 0, 700, 33, 1)]
    writer = bitplanes.Writer(out, block=64)
    for k, p in enumerate(parts):
        writer.add(p, [k], np.array([len(p)]))
    with pytest.raises(ValueError):
        writer.add(np.array([1 << 16], np.uint32), [9], np.array([1]))
    writer.close()
    reader, whole = bitplanes.Reader(out), np.concatenate(parts)
    for a, b in ((0, 739), (63, 65), (100, 100), (700, 9999), (-3, 5)):
        assert (reader.read(a, b) == whole[max(a, 0) : b]).all()
    assert [(d, i.tolist()) for d, i in reader.documents()] == [(k, p.tolist()) for k, p in enumerate(parts)]
    with pytest.raises(ValueError):
        bitplanes.Reader(Memory(out.getvalue()[:-4]))


def test_token_files(docs, empty, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    rows = sorted(((r.doc_id is not None, r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0], r[1] or 0, r[2]))
    start, expected = 0, []
    for _, doc_id, text in rows:
        ids = np.array(whole.encode(text, add_special_tokens=False).ids + [1], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in bitplanes.token_files(docs, block=256).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected
    assert bitplanes.token_files(empty).collect() == []


def check_packing(rows, n_docs):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by_sequence), sum(r.length for r in rows)


def test_packing(spark, docs, empty):
    long = spark.createDataFrame([(1000, "word " * 5000)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(long)
    rows = packing.pack(both).collect()
    n, total = check_packing(rows, both.count())
    assert n <= -(-total // 4096) + 2
    pieces = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 1000)
    assert pieces == [(0, 0, 4096), (1, 4096, 905)]
    assert packing.pack(empty).collect() == []


def test_a_worker_holds_one_encoder():
    assert encoder() is encoder(VOCABULARY) is encoder(VOCABULARY, END_ID) is encoder(VOCABULARY, end=END_ID)


def test_packing_counts_take_few_files(spark, docs, monkeypatch):
    """The counts of lengths are few: many shuffle partitions don't become as many files."""
    wrote, conf = [], {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    monkeypatch.setattr(packing, "settle", lambda df, name: wrote.append(store.settle(df, name)) or wrote[-1])
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = packing.pack(docs).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    check_packing(rows, docs.count())
    assert len(wrote) == 2 and len(wrote[1][0].inputFiles()) <= packing.COUNT_FILES


def test_plan_places_every_length():
    rng = np.random.default_rng(0)
    for sizes in (rng.integers(1, 4097, 3000), rng.integers(20, 300, 500), np.full(700, 4096), np.array([5]), rng.integers(900, 1200, 400)):
        histogram = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))))
        plan = packing.plan_sequences(histogram)
        have = {}
        for lengths, n in plan:
            assert sum(lengths) <= 4096 and n > 0
            for x in lengths:
                have[x] = have.get(x, 0) + n
        assert have == histogram


def test_fit_counts_is_the_nonnegative_optimum():
    shapes, histogram = packing.patterns(12, 3), np.random.default_rng(3).integers(0, 50, 12).astype(float)
    x = packing.fit_counts(shapes, histogram, 4000)
    slope = shapes @ (x @ shapes - histogram)
    assert (x >= 0).all() and (slope >= -0.1).all() and (abs(slope[x > 0.5]) < 0.1).all()


def brute_links(texts, width, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    links = [[] for _ in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i].append(j)
                links[j].append(i)
    return sets, links


def smallest(ids, links):
    out = []
    for k in range(len(ids)):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        known = [ids[j] for j in seen if ids[j] is not None]
        out.append(min(known) if known else None)
    return out


@pytest.mark.parametrize("width,percent,block", [(3, 90, 4096), (5, 80, 4096), (2, 50, 3)])
def test_jaccard_join(docs, empty, width, percent, block):
    rows = docs.select("doc_id", "text").collect()
    sets, links = brute_links([r.text for r in rows], width, percent)
    ids = [r.doc_id for r in rows]
    component = [c if s else i for c, s, i in zip(smallest(ids, links), sets, ids)]
    expected = sorted(((i if i is not None else -1), len(s), (c if c is not None else -1), len(x)) for i, s, c, x in zip(ids, sets, component, links))
    got = triejoin.jaccard_classes(docs, width, percent, block).collect()
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.n_shingles, (r.component_id if r.component_id is not None else -1), r.n_links) for r in got) == expected
    if block == 4096 and width == 3:
        assert triejoin.jaccard_classes(empty, width, percent).collect() == []


def test_one_of_each(docs):
    kept = triejoin.one_of_each(docs)
    assert kept.columns == docs.columns
    found = {r.doc_id: r.component_id for r in triejoin.jaccard_classes(docs, 5, 80).collect()}
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(d for d, c in found.items() if d is not None and d == c)
    assert kept.where("doc_id is null").count() == 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    links = {}
    for a, b in edges:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    links = {a: x for a, x in links.items() if x != {a}}
    nodes = sorted(links)
    at = {n: k for k, n in enumerate(nodes)}
    expected = dict(zip(nodes, smallest(nodes, [[at[b] for b in links[n] if b in at] for n in nodes])))
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == expected


def brute_removed(rows, width=20):
    first = {}
    lists = [(r[0] if r[0] is not None else -(1 << 63), (r[1] or "").encode().split()) for r in rows]
    for d, w in lists:
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            first[key] = min(first.get(key, (d, s)), (d, s))
    out = []
    for d, w in lists:
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < (d, s):
                gone[s : s + width] = [True] * width
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3, 5])
def test_substring_dedup(docs, empty, batches):
    rows = docs.select("doc_id", "text").collect()
    got = substrings.deduplicate(docs, batches=batches).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -(1 << 63), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removed(rows)
    if batches == 1:
        assert substrings.deduplicate(empty).collect() == []


def test_substring_rows_and_growing_index(spark, docs):
    pruned = substrings.deduplicate(docs, rows=True)
    assert pruned.columns == docs.columns and pruned.count() == docs.count()
    before = {(r.doc_id, r.text) for r in docs.collect()}
    for r in pruned.collect():
        assert (r.doc_id, r.text) in before or r.n_chars == len(r.text)
    index = substrings.Index.create(spark, fanout=2, buckets=4)
    known = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    for k in range(4):
        substrings.deduplicate(known.where(F.col("doc_id") % 4 == k), index=index, batches=1)
    assert [run.level for run in index.runs] == [2]
    again = substrings.deduplicate(known, index=index, batches=1)
    assert again.where("n_words >= 20 and n_removed < n_words").count() == 0
    # a lost or cut file is an error, never an empty range
    lost = next((b for b, n in index.runs[0].files.items() if n > 40))
    path = f"{index.folder.removeprefix('file:')}/{index.runs[0].name}/{lost:05d}.run"
    whole = open(path, "rb").read()
    for data in (None, whole[:-3]):
        os.remove(path) if data is None else open(path, "wb").write(data)
        with pytest.raises(Exception, match="FileNotFound|No such file|bytes of"):
            substrings.deduplicate(known, index=index, batches=1).collect()
    # so is a folder that isn't the driver's
    open(path, "wb").write(whole)
    with pytest.raises(Exception, match="shared by all executors"):
        open(f"{index.folder.removeprefix('file:')}/{substrings.MARK}", "w").write("other")
        substrings.deduplicate(known, index=index, batches=1).collect()
    index.drop()


def test_hashes_that_repeat_with_other_checks():
    rng = np.random.default_rng(5)
    known = np.sort(rng.integers(0, 40, 300).astype(np.uint64))
    checks = rng.integers(0, 30, 300).astype(np.uint16)
    value, check = rng.integers(0, 45, 500).astype(np.uint64), rng.integers(0, 30, 500).astype(np.uint16)
    pairs = set(zip(known.tolist(), checks.tolist()))
    assert substrings.among(value, check, known, checks).tolist() == [x in pairs for x in zip(value.tolist(), check.tolist())]
    assert not substrings.among(value, check, known[:0], checks[:0]).any()


def test_folders_as_spark_names_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "configured", lambda _: str(tmp_path))  # no scheme: Hadoop's default file system
    assert store.shared_dir(spark) == f"file:{tmp_path}"
    docs = spark.createDataFrame([(k, "one two three " * 9) for k in range(3)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substrings.deduplicate(docs, batches=2).collect()) == [24, 27, 27]
    assert bitplanes.token_files(docs).count() == 3 and len(os.listdir(tmp_path)) > 2
    assert spark.conf.get(store.CLEAN, None) is None
    assert store.open_fs("dbfs:/x/y")[1] == "/dbfs/x/y" and store.open_fs("file:///x")[1] == "/x" and store.open_fs("/x")[1] == "/x"
    with pytest.raises(ValueError, match="wasbs"):
        store.open_fs("wasbs://a@b/c")


def test_fertility_counts(docs, empty, texts):
    import re

    def counts(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        seen = {}
        for s in range(len(w) - 7):
            seen.setdefault(tuple(w[s : s + 8]), []).append(s)
        gone = {s + k for v in seen.values() if len(v) > 1 for s in v for k in range(8)}
        lines = [x for x in (t or "").encode().split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
        n, r = len(w), len(gone)
        return (n, sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n)

    extra = ["a b c d e f g h i " * 9, "x\ny\nx\n y\n", "* " * 50]
    spark = docs.sparkSession
    both = spark.createDataFrame([*enumerate(texts), *enumerate(extra, 5000)], "doc_id long, text string")
    got = {r.doc_id: r for r in fertility.judge(both).collect()}
    for k, t in [*enumerate(texts), *enumerate(extra, 5000)]:
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(t)
        assert not (r.kept and r.base_failed)
    assert got[texts.index(None)].chars_per_piece is None
    assert fertility.judge(empty).collect() == []


def test_fertility_figures():
    own, words = fertility.Fertility(), Words(pa.array(["hello world hello", "日本", None]))
    figures = own.of(words)
    ids = [i for w in ("hello", "world", "hello") for i in own.pieces.encode(w)]
    p = np.array([ids.count(i) for i in set(ids)]) / len(ids)
    assert figures["pieces"].tolist()[0] == len(ids) and figures["entropy"][0] == pytest.approx(-(p * np.log2(p)).sum())
    assert [fertility.SCRIPTS[k] for k in figures["script"]] == ["LATIN", "CJK", "NONE"]


CLEAN = {
    "LATIN": ["Every person who came to the small town by the river that summer remembered the old bridge, the quiet market and the long evenings when neighbours sat together outside and talked about the weather."],
    "GREEK": ["Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.", "Η Αθήνα είναι η πρωτεύουσα της Ελλάδας και μία από τις παλαιότερες πόλεις του κόσμου. Πολλοί επισκέπτες έρχονται κάθε χρόνο για να δουν τα μνημεία, τα μουσεία και τις αγορές της."],
    "CYRILLIC": ["Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.", "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства.", "Всички хора се раждат свободни и равни по достойнство и права. Те са надарени с разум и съвест и следва да се отнасят помежду си в дух на братство."],
    "ARABIC": ["يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. لكل إنسان حق التمتع بكافة الحقوق والحريات الواردة في هذا الإعلان دون أي تمييز.", "تمام افراد بشر آزاد به دنیا می آیند و از لحاظ حیثیت و حقوق با هم برابرند. همه دارای عقل و وجدان هستند و باید نسبت به یکدیگر با روح برادری رفتار کنند.", "تمام انسان آزاد اور حقوق و عزت کے اعتبار سے برابر پیدا ہوئے ہیں۔ انہیں ضمیر اور عقل ودیعت ہوئی ہے۔ اس لئے انہیں ایک دوسرے کے ساتھ بھائی چارے کا سلوک کرنا چاہئے۔"],
    "HEBREW": ["כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה. כל אדם זכאי לזכויות ולחירויות שנקבעו בהכרזה זו ללא הפליה כלשהי.", "ירושלים היא עיר הבירה של ישראל ואחת הערים העתיקות בעולם. בכל שנה באים אליה מבקרים רבים כדי לראות את החומות, את השווקים ואת המוזיאונים שלה."],
    "DEVANAGARI": ["सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए।", "सर्व मानवी व्यक्ती जन्मतःच स्वतंत्र आहेत व त्यांना समान प्रतिष्ठा व समान अधिकार आहेत. त्यांना विचारशक्ती व सदसद्विवेकबुद्धी लाभलेली आहे व त्यांनी एकमेकांशी बंधुत्वाच्या भावनेने आचरण करावे."],
    "HANGUL": ["모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다. 모든 사람은 이 선언에 규정된 모든 권리와 자유를 향유할 자격이 있다.", "서울은 대한민국의 수도이며 가장 큰 도시이다. 한강이 도시의 가운데를 흐르고 많은 사람들이 매일 지하철과 버스를 타고 출근한다. 봄에는 꽃이 피고 가을에는 산이 붉게 물든다."],
    "HIRAGANA": ["すべての 人間は、 生まれながらにして 自由であり、 かつ、 尊厳と 権利とに ついて 平等である。 人間は、 理性と 良心とを 授けられており、 互いに 同胞の 精神を もって 行動しなければ ならない。 わたしは きのう ともだちと いっしょに まちへ いきました。", "むかし むかし ある ところに おじいさんと おばあさんが いました。 おじいさんは やまへ しばかりに、 おばあさんは かわへ せんたくに いきました。 おばあさんが かわで せんたくを していると おおきな ももが ながれて きました。"],
    "KATAKANA": ["コンピューター ソフトウェア インターネット テレビ ラジオ ホテル レストラン コーヒー ビール ワイン パン ケーキ アメリカ フランス ドイツ イギリス スポーツ サッカー テニス ニュース カメラ バス タクシー エレベーター"],
    "CJK": ["人人 生 而 自由, 在 尊严 和 权利 上 一律 平等。 他们 赋有 理性 和 良心, 并 应 以 兄弟 关系 的 精神 相 对待。 人人 有 资格 享有 本 宣言 所 载 的 一切 权利 和 自由。", "北京 是 中国 的 首都, 也是 世界 上 最 古老 的 城市 之一。 每年 有 很多 人 来 这里 参观 故宫 和 长城。 春天 的 时候 公园 里 开 满 了 花。"],
    "THAI": ["มนุษย์ ทั้งหลาย เกิด มา มี อิสระ และ เสมอภาค กัน ใน เกียรติศักดิ์ และ สิทธิ ต่าง มี เหตุผล และ มโนธรรม และ ควร ปฏิบัติ ต่อ กัน ด้วย เจตนารมณ์ แห่ง ภราดรภาพ ทุกคน ย่อม มี สิทธิ และ อิสรภาพ", "กรุงเทพมหานคร เป็น เมืองหลวง และ เมือง ที่ ใหญ่ ที่สุด ของ ประเทศไทย ทุกปี มี นักท่องเที่ยว จำนวนมาก เดินทาง มา ชม วัด ตลาด และ พิพิธภัณฑ์ อาหาร ของ ที่นี่ มี ชื่อเสียง ไป ทั่วโลก"],
}
#: Letters of the scripts whose fertility is judged.
LETTERS = {
    "LATIN": "abcdefghijklmnopqrstuvwxyz",
    "GREEK": "αβγδεζηθικλμνξοπρστυφχψω",
    "CYRILLIC": "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "DEVANAGARI": "अआइईउऊएऐओऔकखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह",
    "HANGUL": [chr(c) for c in range(0xac00, 0xd7a4)],
    "HIRAGANA": [chr(c) for c in range(0x3041, 0x3094)],
    "CJK": [chr(c) for c in range(0x4e00, 0x9fa6)],
    "THAI": [chr(c) for c in range(0xe01, 0xe2f)],
}


def test_fertility_tells_clean_text_from_random_letters(spark):
    rng = random.Random(21)
    texts = [(k, True, t) for k, ts in CLEAN.items() for t in ts]
    texts += [(k, False, " ".join("".join(rng.choice(v) for _ in range(rng.randint(2, 9))) for _ in range(n))) for k, v in LETTERS.items() for n in (20, 60, 200, 200)]
    got = {r.doc_id: r for r in fertility.judge(spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(texts)], "doc_id long, text string")).collect()}
    assert [(k, got[i].kept) for i, (k, clean, _) in enumerate(texts)] == [(k, clean) for k, clean, _ in texts]
    assert all(got[i].script == k or (k, got[i].script) == ("HIRAGANA", "CJK") for i, (k, _, _) in enumerate(texts))


def test_forward_sums_all_segmentations():
    pieces, table = langid.vocabulary(), langid.piece_table()
    weights = np.random.default_rng(0).random((len(pieces) + 1, 3))
    weights /= weights.sum(0)

    def brute(r, k):
        if not r:
            return 1.0
        own = weights[0, k] * brute(r[1:], k) if r[0] not in pieces else 0.0
        return own + sum(weights[pieces[r[:j]], k] * brute(r[j:], k) for j in range(1, min(langid.MAX_PIECE, len(r)) + 1) if r[:j] in pieces)

    runs = ["▁thing", "▁ñandú", "▁a", "▁日本x", "▁wordandword"]
    expected = np.array([[np.log(brute(r, k)) for k in range(3)] for r in runs])
    assert langid.score_many(runs, weights, table, pieces) == pytest.approx(expected)
    assert np.array([langid.score_runs([r], pieces, weights.tolist(), 3) for r in runs]) == pytest.approx(expected)
    longest = "▁" + "thing" * 300
    assert np.isfinite(langid.score_runs([longest], pieces, weights.tolist(), 3)).all()


def test_expected_uses_of_all_segmentations():
    pieces, table, rng = langid.vocabulary(), langid.piece_table(), np.random.default_rng(1)
    weights = rng.random((len(pieces) + 1, 2)) ** 8
    weights /= weights.sum(0)

    def cuts(r):
        if not r:
            yield ()
        for j in range(1, len(r) + 1):
            if r[:j] in pieces or j == 1:
                for rest in cuts(r[j:]):
                    yield (pieces.get(r[:j], 0), *rest)

    found = ["▁thing", "▁ñandú", "▁a", "▁日本x", "▁wordandword", "▁thing", "▁politic"]
    lang, times = np.array([0, 1, 0, 1, 1, 1, 0]), np.array([3, 1, 7, 2, 1, 4, 2])
    expected = np.zeros(weights.shape)
    for r, k, n in zip(found, lang, times):
        ways = [(c, np.prod(weights[list(c), k])) for c in cuts(r)]
        for c, w in ways:
            for p in c:
                expected[p, k] += n * w / sum(x for _, x in ways)
    assert langid.expect_many(found, times, lang, weights, table, pieces) == pytest.approx(expected)
    one = np.zeros(weights.shape)
    for r, k, n in zip(found, lang, times):
        for p, x in langid.expected(r, pieces, weights[:, k].tolist()):
            one[p, k] += n * x
    assert one == pytest.approx(expected)
    for r in found:  # passes taken in steps are the same
        assert dict(langid.expected(r, pieces, weights[:, 0].tolist(), 2)) == pytest.approx(dict(langid.expected(r, pieces, weights[:, 0].tolist())))
    # words far longer than the range of doubles: their pieces still cover each character once
    long = ["▁" + "ღthing" * 400, "ღ" * 40]
    uses = langid.expect_many(long, np.array([1, 2]), np.array([0, 1]), weights, table, pieces)
    size = np.array([1, *map(len, pieces)])
    assert size @ uses == pytest.approx([2401, 80])


def test_pieces_are_the_whole_vocabulary():
    whole, own = langid.vocabulary(longest=1000), langid.vocabulary()
    assert set(own) == set(whole) and max(map(len, whole)) <= langid.MAX_PIECE
    assert {"frequency", langid.MARK + "attempting", langid.MARK + "política"} <= set(own)
    # the training passes reach them, and no long word of single characters is lost
    weights = np.array([8.0 ** (len(p) - 1) for p in ["?", *own]])
    run = langid.MARK + "attempting"
    assert own[run] in {p for p, _ in langid.expected(run, own, (weights / weights.sum()).tolist())}
    assert langid.expected("ღ" * 40, own, (weights / weights.sum()).tolist())


def test_language_id(spark, empty):
    rng = random.Random(2)
    voc = {"en": "the house over river with water these words".split(), "fr": "le maison rivière avec été deux mots où".split()}
    rows = [(k, " ".join(rng.choice(voc[lang]) for _ in range(30)), lang) for k, lang in enumerate(["en", "fr"] * 60)]
    rows += [(500, None, "en"), (501, "123 !!", "fr"), (502, "", None), (503, "maison où été", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(docs, langid.train(docs.where("doc_id % 4 <> 2"))).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows[:120])
    assert [got[k].lang_pred for k in (500, 501, 502)] == ["und"] * 3 and got[503].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.predict(docs, langid.train(docs.where("false"))).collect()} == {"und"}
    assert langid.predict(empty, langid.train(empty)).collect() == []
    # letter runs without spaces, however long, are learned from and scored
    long = spark.createDataFrame([(k, "".join(rng.choice(v) for _ in range(300)), x) for k, (x, v) in enumerate([("ja", "あいうえお"), ("el", "αβγδε")] * 20)], docs.schema)
    assert [r.lang_pred for r in langid.predict(long, langid.train(long.where("doc_id < 30"))).orderBy("doc_id").collect()] == ["ja", "el"] * 20
    with pytest.raises(ValueError, match="languages"):
        langid.train(spark.createDataFrame([(k, "a", f"l{k}") for k in range(langid.MOST_LANGUAGES + 1)], docs.schema))


def test_qda_is_the_gaussian_rule():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (200, 4)), rng.normal(1, 2, (150, 4))])
    y = np.repeat([0, 1], [200, 150])
    n = np.array([200.0, 150.0])
    model = qda.discriminant(n, np.array([x[y == k].sum(0) for k in (0, 1)]), np.array([x[y == k].T @ x[y == k] for k in (0, 1)]), 0.0, 0.0)
    z = (x - x.mean(0)) / x.std(0)
    logs = []
    for k in (0, 1):
        s, m = np.cov(z[y == k].T, bias=True), z[y == k].mean(0)
        d = z - m
        logs.append(np.log((n[k] + 1) / 352) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])), abs=1e-6)


def test_quality_classifier(spark, docs, empty):
    rng = random.Random(3)
    rows, marks = [], []
    for k in range(300):
        good = k % 3 > 0
        rows.append((k, prose(rng, 60) if good else prose(rng, 2).upper().replace(" ", "!! ") * 30))
        marks.append((k, int(good)))
    rows += [(900, None), (901, ""), (902, "x")]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (7, None), (None, 1), (12345, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in qda.train_and_score(texts, labels, F.col("doc_id") % 4 > 0).collect()}
    held = [k for k in range(300) if k % 4 == 0]
    assert np.mean([got[k].predicted == int(k % 3 > 0) for k in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values()) and len(got) == 303
    kept = qda.keep_good(texts, labels)
    assert kept.columns == texts.columns and {r.doc_id for r in kept.collect()} >= {k for k in range(300) if k % 3 > 0}
    none = labels.where("false")
    assert qda.train_and_score(docs, none).count() == docs.count()
    assert qda.train_and_score(empty, labels).collect() == []


def test_levenshtein_automaton():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i, *[0] * len(b)], row
            for j, y in enumerate(b, 1):
                row[j] = min(row[j - 1] + 1, last[j] + 1, last[j - 1] + (x != y))
        return row[-1]

    rng = random.Random(4)
    terms = ["abc", "abcd", "abcde", "bcdefab", "abcdefgh", "hgfedcba", "aaaaaaaa"]
    own = toxicity.Automaton(terms, ["stem"])
    for _ in range(3000):
        base = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            op = rng.randrange(3)
            at = rng.randrange(len(base) + 1)
            base[at : at + (op > 0)] = [] if op == 1 else [rng.choice("abcdefgh")]
        word = "".join(base)
        near = [(distance(t, word), k) for k, t in enumerate(terms) if distance(t, word) <= toxicity.allowed(t, False)]
        assert own.find(word) == ((min(near)[1], min(near)[0]) if near else None), word
    assert own.find("stemming") == (len(terms), 0) and own.find("stam") is None


def test_toxicity(spark, empty):
    rng = random.Random(6)
    bad = ["blockhead", "nincompoop", "dimwit"]
    rows, marks = [], []
    for k in range(400):
        w = prose(rng, 40).split()
        if k % 4 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((k, " ".join(w)))
        marks.append((k, int(k % 4 == 0)))
    rows += [(900, "you are a blokhead and a nincompooop"), (901, None), (902, ""), (903, "a calm sentence of words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert set(bad) <= {*model.words} and all(got[k].predicted == (k % 4 == 0) for k in range(400) if k % 3 == 1)
    assert got[900].predicted == 1 and [got[k].predicted for k in (901, 902, 903)] == [0] * 3
    quoted = Words(pa.array(['he said "you blockhead today" and left', "well you blockhead today and left"]))
    x, _ = toxicity.Matcher(model).features(quoted)
    assert x[0, 3] < x[1, 3] and x[0, 0] > 0 and x[1, 0] == 0
    assert toxicity.score(empty, toxicity.train(empty, labels)).collect() == []


def test_stems_leave_words_their_edits(spark):
    own = toxicity.Automaton(["grubby", "grub"], ["grub", "stem"])
    # a typo in the stem's own letters, a word that equals the stem, and endings that a word's path must not take over
    assert own.find("gruby") == (0, 1) and own.find("grabby") == (0, 1) and own.find("grab") == (1, 1)
    assert own.find("grubworm") == (2, 0) and own.find("grubxxxxby") == (2, 0) and own.find("stemming") == (3, 0) and own.find("grxb") == (1, 1)

    def learn(bad):
        rng = random.Random(12)
        rows = []
        for k in range(600):
            w = prose(rng, 30).split()
            if k % 2:
                w.insert(rng.randrange(len(w)), bad[k // 2 % len(bad)])
            rows.append((k, " ".join(w)))
        return toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(600)], "doc_id long, toxic int"))

    family = ["grubstake", "grubhunter", "grubworm", "grubbing"]
    model = learn(family)
    found = toxicity.Automaton(model.words, model.stems)
    assert model.stems == ["grub"] and set(family) <= {*model.words}
    assert found.find("grabworm") == (found.terms.index("grubworm"), 1) and found.find("gruxhxnter") == (found.terms.index("grubhunter"), 2)
    # misspellings of one term are no family
    assert toxicity.different(["clown", "cloun", "clowm", "clowwn", "clowns"], 4) == 1 and toxicity.different(family, 4) == 4
    model = learn(["clown"] * 12 + ["clowm", "clowwn", "clowne", "clwon", "clowb", "clow"])
    assert model.stems == [] and "clown" in model.words


def brute_nearest(rows, asked, k=10):
    out = {}
    for q, v in asked:
        d = sorted({(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in rows if i != q and len(w) == len(v)})[:k]
        out[q] = d
    return out


def test_nearest(spark):
    rng = np.random.default_rng(0)
    points = [(k, rng.normal(0, 1, 8).astype(np.float32).tolist()) for k in range(900)]
    points += [(2000 + k, points[0][1]) for k in range(300)] + [(4000 + k, [1.0, 2.0]) for k in range(3)]
    odd = [(5000, None), (5001, []), (5002, [0.0] * 8), (5003, [1.0, None] + [0.0] * 6), (5004, [float("nan")] * 8), (5005, [float("inf")] * 8), (None, points[3][1]), points[5]]
    vectors = spark.createDataFrame(points + odd, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    expected = brute_nearest(points, [p for p in points if p[0] % 100 == 0])
    for shard in (10_000, 200):
        got = {}
        for r in graphsearch.search(graphsearch.build_index(vectors, shard), vectors.where("vec_id % 100 = 0")).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
        assert set(got) == set(expected)
        hits = sum(len({v for _, v in got[q].values()} & {v for _, v in expected[q]}) for q in expected)
        assert hits >= 0.95 * sum(map(len, expected.values()))
        assert [v for _, v in sorted(got[0].items())] == expected[0] and [v for _, v in sorted(got[4000].items())] == expected[4000]
    none = vectors.where("false")
    assert graphsearch.nearest(none, none).collect() == []


def test_search_looks_at_a_small_share():
    rng = np.random.default_rng(3)
    points = rng.normal(0, 1, (40, 12))[rng.integers(0, 40, 6000)] + rng.normal(0, 0.4, (6000, 12))
    points[:400] = points[0] + rng.normal(0, 0.01, (400, 12))  # a crowded spot
    edges, start = graphsearch.build_graph(points)
    near = (points - points.mean(0)).astype(np.float32)
    asked = np.r_[0:400:20, 400:6000:50]
    found, _, looked = graphsearch.beam_search(near, edges, start, near[asked], graphsearch.SEARCH_BEAM, graphsearch.POOL, 11)
    true = np.argsort(((points[None] - points[asked][:, None]) ** 2).sum(2), axis=1)[:, :11]
    assert np.mean([len({*a[:11].tolist()} & {*b.tolist()}) / 11 for a, b in zip(found, true)]) > 0.95
    assert looked.mean() < 0.15 * len(points)


def test_pruning_keeps_diverse_neighbours():
    rng = np.random.default_rng(4)
    points = rng.normal(0, 1, (60, 3)).astype(np.float32)
    candidates = rng.integers(0, 61, (5, 25))  # 60 is none, some stand twice
    kept = graphsearch.prune_many(points, np.arange(5), candidates.copy(), 6, 1.2)
    for own, some, got in zip(range(5), candidates, kept):
        left = sorted({*some.tolist()} - {60, own}, key=lambda c: ((points[c] - points[own]) ** 2).sum())
        expected = []
        for c in left:
            if len(expected) < 6 and all(1.44 * ((points[c] - points[x]) ** 2).sum() > ((points[c] - points[own]) ** 2).sum() for x in expected):
                expected.append(c)
        assert [x for x in got.tolist() if x < 60] == expected


def test_mixing_meets_targets(spark, docs, empty):
    rng = random.Random(8)
    voc = {"a": WORDS[:8], "b": WORDS[8:]}
    rows = [(k, " ".join(rng.choice(voc[d]) for _ in range(20 + k % 30)), d if k % 5 else None) for k, d in enumerate(["a", "a", "a", "b"] * 60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    model = mixing.train(table)
    members = mixing.memberships(table, model)
    found = mixing.fit(members, model.domains, {"a": 0.5, "b": 0.5}, grow=False)
    pdf = members.toPandas()
    p, t = np.array(pdf["p"].tolist()), pdf["n_tokens"].to_numpy(float)
    r = found.rates(p)
    reached = (r * t) @ p
    assert (r >= 0).all() and reached == pytest.approx([t.sum() / 2] * 2, rel=1e-3) and found.reached == pytest.approx(reached)
    # the same fit by plain projected gradient on all rates at once
    goal, plain = np.array([t.sum() / 2] * 2), np.ones(len(t))
    for _ in range(3000):
        plain = np.maximum(0, plain - 0.3 * (p @ (((plain * t) @ p - goal) / goal)))
    assert r == pytest.approx(plain, abs=0.02)
    mixed = mixing.mix(table, table, {"a": 0.5, "b": 0.5})
    assert mixed.columns == table.columns and mixed.count() >= table.count()
    got = mixing.rates(docs, docs.select("doc_id", "text", F.col("lang").alias("domain")))
    assert got.count() == docs.count() and got.where("rate < 0.99 or copies < 1").count() == 0
    assert mixing.rates(table, table.where("false")).where("abs(rate - 1) > 0.01").count() == 0
    # documents of two domains at once: none has to go for them
    both = table.unionByName(spark.createDataFrame([(1000 + k, " ".join(rng.choice(voc["ab"[j % 2]]) for j in range(30)), None) for k in range(60)], table.schema))
    assert mixing.rates(both, both).where("rate < 1 or copies < 1").count() == 0
    clash = both.withColumn("_rate", F.lit("x")).withColumn("_COPIES", F.lit(1)).withColumn("_copy", F.lit(2))
    mixed = mixing.mix(clash, both)
    assert mixed.columns == clash.columns and mixed.select("doc_id").distinct().count() == both.count()
    with pytest.warns(UserWarning, match="rounds"):
        assert not mixing.fit(members, model.domains, {"a": 0.5, "b": 0.5}, rounds=1).met
    with pytest.raises(ValueError, match="domains"):
        mixing.train(table.withColumn("domain", F.col("doc_id").cast("string")).unionByName(table.withColumn("domain", F.concat(F.lit("x"), "doc_id"))))
    assert mixing.rates(empty, empty.select("doc_id", "text", F.col("lang").alias("domain"))).collect() == []


def test_words_of_slices():
    """Rows past the first slice of a batch: their text starts inside the batch's buffer."""
    from sarvgrid.llm.words import slices

    rng = random.Random(9)
    texts = [prose(rng, 40).upper() if k % 9 else None for k in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    got = []
    for part in slices([batch], "text", 2000):
        values, bounds = shingle_sets(Words(part.column("text"), lower=True), 3)
        got += [set(values[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    whole, bounds = shingle_sets(Words(pa.array(texts), lower=True), 3)
    assert got == [set(whole[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])] and len(got) == 300


def test_jaccard_join_over_many_slices(spark, monkeypatch):
    rng = random.Random(10)
    texts = [prose(rng, 60) for _ in range(150)]
    texts += [" ".join("changed" if i == 30 else w for i, w in enumerate(t.split())) for t in texts[:50]] + texts[50:90]
    monkeypatch.setattr(triejoin, "SLICE", 3000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    sets, links = brute_links(texts, 3, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in triejoin.jaccard_classes(docs, 3, 80).collect()}
    component = smallest(list(range(len(texts))), links)
    assert got == {k: (len(sets[k]), component[k], len(links[k])) for k in range(len(texts))}


def test_scorers_on_odd_input(spark, docs, texts):
    """Blank, null and odd texts, a repeated row, a null id, and columns called like the operators' own."""
    marks = spark.createDataFrame([(k, k % 2, k % 2) for k in range(len(texts) - len(ODD))] + [(3, 1, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    found = {
        "score": qda.train_and_score(docs, marks).collect(),
        "lang": [r.asDict() | {"score": (r.lang_pred, r.score)} for r in langid.predict(docs, langid.train(docs)).collect()],
        "toxic": toxicity.score(docs, toxicity.train(docs, marks)).collect(),
    }
    by_text = {k: t for k, t in enumerate(texts)} | {None: "a text without an id of seven words"}
    for name, rows in found.items():
        assert len(rows) == len(texts) + 2
        scores: dict = {}
        for r in rows:
            scores.setdefault(r["doc_id"], set()).add(r["score"])
        assert all(len(x) == 1 for x in scores.values()), name  # the repeated row scores as it did
        blank = {x for k, x in ((k, next(iter(v))) for k, v in scores.items()) if not (by_text[k] or "").strip()}
        assert len(blank) == 1, name
        values = [r["score"][1] if name == "lang" else r["score"] for r in rows]
        assert all(0 <= v <= 1 for v in values)
    assert {r["lang_pred"] for r in found["lang"] if not any(c.isalpha() for c in by_text[r["doc_id"]] or "")} == {"und"}
    assert qda.keep_good(docs, marks).columns == docs.columns
    kept = [tuple(r) for r in qda.keep_good(docs, marks, threshold=0.0).collect()]
    assert sorted(kept, key=repr) == sorted((tuple(r) for r in docs.collect()), key=repr)


def test_scores_do_not_depend_on_the_batch(spark):
    """A text's statistics and score are the same to the last bit whatever stands before and behind it."""
    rng, numbers = random.Random(20), np.random.default_rng(20)
    vocabulary = [prose(rng, 1) for _ in range(150)]
    texts = [" ".join(rng.choices(vocabulary, range(1, 151), k=rng.randrange(1, 900))) for _ in range(90)]
    x = qda.statistics(pa.array(texts))
    assert (x == qda.statistics(pa.array(texts[::-1]))[::-1]).all()
    assert (x == np.vstack([qda.statistics(pa.array([t])) for t in texts])).all()
    y = np.arange(len(x)) % 2
    model = qda.discriminant(np.bincount(y).astype(float), np.array([x[y == k].sum(0) for k in (0, 1)]), np.array([x[y == k].T @ x[y == k] for k in (0, 1)]))
    scores = model.score(x)
    for rows in (range(1), range(3), range(7, 20), range(1, len(x))):
        assert (model.score(x[rows.start : rows.stop]) == scores[rows.start : rows.stop]).all()

    bad = [prose(rng, 1) for _ in range(40)]
    learned = toxicity.Model(bad, [], {(t, e): float(v) for t in range(40) for e, v in enumerate(numbers.normal(1, 1, 3))}, beta=numbers.normal(0, 0.3, toxicity.FEATURES + 1))
    marked = [" ".join(rng.choices([*bad, "you", "said", "plain", "words"], k=rng.randrange(3, 60))) for _ in range(60)]
    rows = [t for k in range(1, 12) for t in marked[:: k % 3 + 1][k:]] + marked
    found: dict = {}
    for text, r in zip(rows, toxicity.score(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1), learned).orderBy("doc_id").collect(), strict=True):
        found.setdefault(text, set()).add(r.score)
    assert len(found) == 60 and all(len(v) == 1 for v in found.values())


def test_texts_longer_than_a_slice(spark):
    """Texts of 3 million characters and words of 50 000, beside short ones: no operator cuts them."""
    from tokenizers import Tokenizer

    rng = random.Random(14)
    vocabulary = [prose(rng, 1) for _ in range(4000)]
    words = [rng.choice(vocabulary) for _ in range(300_000)]
    long = " ".join(words)
    changed = words.copy()
    changed[150_000] = "changed"
    texts = [long, "a short text of some seven words", " ".join(changed), "x" * 50_000, None, "é" * 20_000 + " " + " ".join(words[:30])]
    assert all(len(t.encode()) > 2 << 20 for t in (texts[0], texts[2]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    whole = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    ids = [np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in texts]
    got = bitplanes.token_files(docs).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(i), zlib.crc32(i.tobytes())) for i in ids]
    pieces = packing.pack(docs).collect()
    assert sum(r.length for r in pieces) == sum(map(len, ids)) and check_packing(pieces, 6)[0] <= -(-sum(map(len, ids)) // 4096) + 2
    joined = {r.doc_id: r for r in triejoin.jaccard_classes(docs, 3, 90).collect()}
    sets, links = brute_links(texts, 3, 90)
    assert {k: (r.n_shingles, r.component_id, r.n_links) for k, r in joined.items()} == {k: (len(sets[k]), smallest(list(range(6)), links)[k], len(links[k])) for k in range(6)}
    removed = substrings.deduplicate(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in removed) == brute_removed(list(enumerate(texts)))
    counted = {r.doc_id: r for r in fertility.judge(docs).collect()}
    assert [counted[k].n_words for k in range(6)] == [len((t or "").split()) for t in texts] and counted[0].word_chars == sum(map(len, words))
    marks = spark.createDataFrame([(k, k % 2, k % 2) for k in range(6)], "doc_id long, quality int, toxic int")
    known = docs.withColumn("lang", F.when(F.col("doc_id") < 3, "en").otherwise("fr"))
    for rows in (qda.train_and_score(docs, marks), langid.predict(docs, langid.train(known)), toxicity.score(docs, toxicity.train(docs, marks)), mixing.rates(docs, known.withColumnRenamed("lang", "domain"))):
        assert rows.count() == 6
