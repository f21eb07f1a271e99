"""Operators on documents against brute force on the smallest tables, and on odd input."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from siftwell.llm import decontaminate, line_rules, near_copies, packing, passages, pii, quality_model, simhash, token_counts
from siftwell.llm.common import components, scratch
from siftwell.llm.queries import QUERIES
from tests.llm.conftest import LONG, PROSE

FOLDER = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0d]+")
WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def lowered(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))


def groups(pairs, nodes):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    random.seed(2)
    edges = [(random.randint(0, 400), random.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    want = groups(edges, {n for e in edges for n in e})
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: r for n, r in want.items() if Counter(want.values())[r] > 1} == got


def test_scratch_needs_a_shared_folder(spark):
    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        scratch(Elsewhere, "x")


def fingerprint(text):
    w = lowered(text)
    runs = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(spark, texts):
    rows = QUERIES["op8_simhash_vantage"](spark, FOLDER).collect()
    prints = {i: fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    ids = sorted(prints)
    want = groups([(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2], ids)
    assert {r.doc_id: r.component_id for r in rows} == want


def test_close_pairs_of_a_dense_cluster():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = centre[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (40, 30), dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, (40, 30), dtype=np.uint64))
    values = np.unique(near.ravel())
    home, visitors = values[::2], values[1::2]
    a, b = simhash.spanning_links(home, visitors, 2)
    reach = groups(zip(a.tolist(), b.tolist()), values.tolist())
    close = [(int(x), int(y)) for x in home for y in values if x != y and (int(x) ^ int(y)).bit_count() <= 2]
    assert reach == groups(close, values.tolist())
    assert len(a) < len(values)


def test_simhash_odd_input(odd_docs, no_docs):
    rows = simhash.near_groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    empty = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in empty} == {3, 4, 7, None} and {r.component_id for r in empty} == {3}
    kept = near_copies.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[3] == 1 and ids[4] == 0 and ids[6] == 2 and ids[None] == 2
    assert simhash.near_groups(no_docs).count() == 0 and near_copies.keep_one(no_docs).count() == 0


def test_keep_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, PROSE), (1, PROSE), (9, PROSE)], "doc_id long, text string")
    assert [r.doc_id for r in near_copies.keep_one(docs).collect()] == [1]


def jaccard_groups(texts):
    """Connected components of all pairs with a similarity of 0.8 or more on sets of five words."""
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [lowered(t)]}
    ids = sorted(sets)
    return groups([(a, b) for a in ids for b in ids if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])], ids)


def test_keep_one_against_all_jaccard_pairs(spark, texts):
    named = jaccard_groups(texts)
    prints = {i: fingerprint(t) for i, t in texts.items()}
    assert any((prints[a] ^ prints[b]).bit_count() > 2 for a, b in named.items())  # what fingerprints would lose
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == set(named.values())


def test_keep_one_of_families(spark):
    random.seed(11)
    word = lambda: "".join(random.choice("bdfglmnprstv") + random.choice("aeiou") for _ in range(3))
    made = {}
    for family in range(6):
        text = [word() for _ in range(120)]
        for i in range(40):  # chains of edits and stars of edits, so that many pairs of a family are not similar
            edited = list(text)
            for _ in range(random.randint(1, 3)):
                edited[random.randrange(120)] = word()
            made[100 * family + i] = " ".join(edited)
            text = edited if family % 2 else text
    foot = " ".join(word() for _ in range(60))
    made |= {1000 + i: f"{' '.join(word() for _ in range(20))} {foot}" for i in range(60)}
    named = jaccard_groups(made)
    docs = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == set(named.values())
    assert 6 < len(set(named.values())) < len(made)


def test_line_frequency_spares_copies_and_rejects_depleted(spark):
    random.seed(8)
    some = lambda n: " ".join("".join(random.choice("bdfglmnprstv") + random.choice("aeiou") for _ in range(3)) for _ in range(n))
    line, foot = some(12), [some(9) for _ in range(24)]
    own = [(i, "\n".join([line, *random.sample(foot, 8), some(8)]), "h") for i in range(90)]
    good = [(100 + i, "\n".join([line] + [some(10) for _ in range(12)]), "h") for i in range(30)]
    tale = "\n".join(some(11) for _ in range(9))
    copies = [(200 + i, tale, "h") for i in range(60)]
    docs = spark.createDataFrame(own + good + copies, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in line_rules.quality_rules(docs).collect()}
    assert all(kept[100 + i] for i in range(30)) and all(kept[200 + i] for i in range(60))
    assert not any(kept[i] for i in range(90))
    assert {r.doc_id for r in line_rules.keep_good(docs).collect()} == {i for i, k in kept.items() if k}


def test_line_sql_where_the_rule_bites(spark):
    """Blocks of shared lines, copies, and hosts apart: Spark and SQL reject the same documents, some of them."""
    import duckdb

    from siftwell.llm.oracles import LINE_FREQUENCY
    from tests.compare import differences

    random.seed(12)
    some = lambda n: " ".join("".join(random.choice("bdfglmnprstv") + random.choice("aeiou") for _ in range(3)) for _ in range(n))
    feet, tale = {h: [some(12) for _ in range(9)] for h in "ab"}, "\n".join(some(11) for _ in range(9))
    rows = [(100 * k + i, "\n".join([*random.sample(feet[h], 8), some(random.choice([5, 60]))]), h) for k, h in enumerate("ab") for i in range(30 if h == "a" else 15)]
    rows += [(1000 + i, tale, "a") for i in range(40)] + [(2000, None, "a"), (2001, "", None), (2002, f"  {tale.upper()} ", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    verdicts = line_rules.quality_rules(docs)
    assert differences(verdicts, con, LINE_FREQUENCY) == []
    kept = {r.doc_id for r in verdicts.collect() if r.kept}
    assert 0 < len(kept & set(range(30))) < 30 and kept >= set(range(100, 115)) and kept >= set(range(1000, 1040))


def test_line_frequency_of_blocks_and_a_dominant_copy(spark):
    random.seed(9)
    some = lambda n: " ".join("".join(random.choice("bdfglmnprstv") + random.choice("aeiou") for _ in range(3)) for _ in range(n))
    block, licence = [some(12) for _ in range(8)], some(60)
    blocks = [(i, "\n".join([*block, some(8)]), "block") for i in range(200)]
    story = "\n".join([licence, some(10)])
    held = [(1000 + i, story, "skew") for i in range(80)] + [(2000 + i, "\n".join([licence, some(8)]), "skew") for i in range(40)]
    held += [(3000 + i, "\n".join([some(40), some(40)]), "skew") for i in range(5)]
    docs = spark.createDataFrame(blocks + held, "doc_id long, text string, source string")
    kept = {r.doc_id for r in line_rules.keep_good(docs).collect()}
    assert kept == set(range(3000, 3005))


def test_line_rules_odd_input(odd_docs, no_docs):
    rows = line_rules.quality_rules(odd_docs).collect()
    assert len(rows) == odd_docs.count() and [r.n_words for r in rows if r.doc_id in (3, 4, 7)] == [0, 0, 0]
    kept = line_rules.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {5}
    assert line_rules.quality_rules(no_docs).count() == 0 and line_rules.keep_good(no_docs).count() == 0


def test_tiles_cover_reordered_passages():
    item = [f"w{i}" for i in range(40)]
    moved = ["x"] * 7 + item[25:40] + ["y"] * 3 + item[:25] + ["z"]
    tiles = decontaminate.tile(item, moved, 5)
    assert sum(t[2] for t in tiles) == 40 and len(tiles) == 2
    assert decontaminate.tile(item, ["a"] * 50, 5) == [] and decontaminate.tile([], item, 5) == []
    random.seed(4)
    for _ in range(60):
        a, b = ([random.choice("abc") for _ in range(random.randint(0, 40))] for _ in range(2))
        tiles = decontaminate.tile(a, b, 3)
        used_a = [i + k for i, _, n in tiles for k in range(n)]
        used_b = [j + k for _, j, n in tiles for k in range(n)]
        assert len(set(used_a)) == len(used_a) and len(set(used_b)) == len(used_b)
        assert all(a[i:i + n] == b[j:j + n] and n >= 3 for i, j, n in tiles)
        free = lambda s, used: ["".join(x) for x in zip(*[[w if k not in used else str(k) + side for k, w in enumerate(s)][o:] for o in range(3)])]
        side = "A"
        left = set(free(a, set(used_a)))
        side = "B"
        assert not left & set(free(b, set(used_b)))


def test_contaminated_against_brute_force(spark, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    split = {**{("d", i): t for i, t in texts.items()}, **{("b", i): t for i, t in items.items()}}
    split = {k: [w for w in re.split(r"[\W_]+", t.lower()) if w] for k, t in split.items()}
    want = set()
    for d in texts:
        for b in items:
            n = sum(t[2] for t in decontaminate.tile(split["b", b], split["d", d], 5))
            if n >= 0.6 * len(split["b", b]):
                want.add((d, b))
    assert want and {(r.doc_id, r.item_id) for r in QUERIES["op10_string_tiling"](spark, FOLDER).collect()} == want


def test_decontaminate_odd_input(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, PROSE[:107]), (2, None), (3, ""), (4, "too short"), (None, "the miller watched it from the window of his house")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd_docs, items).collect()}
    assert found == {(d, i) for d in (1, 2, None) for i in (1, None)}
    clean = decontaminate.keep_clean(odd_docs, items)
    assert clean.columns == odd_docs.columns and Counter(r.doc_id for r in clean.collect()) == {3: 1, 4: 1, 5: 1, 6: 2, 7: 1, None: 1}
    assert decontaminate.contaminated(no_docs, items).count() == 0 and decontaminate.keep_clean(odd_docs, items.filter("false")).count() == odd_docs.count()


def test_surrogates(spark):
    texts_ = ["Write to Jo.Doe@mail.acme.org or +1 (212) 555-0187.", "JO.DOE@MAIL.ACME.ORG rang from 212-555-0187, not +1 (212) 555-0187!",
              "Card 4111 1111 1111 1111, also 4111111111111111; host 10.1.2.3; key a3f0a3f0a3f0a3f0a3f0a3f0b1", "Mrs. Ada Weber met Herr Weber and Dr Weber.",
              "Nothing here, only 12 and 1999.", None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace_entities(docs, "k").collect()}
    new = [got[i].text for i in range(len(texts_))]
    assert new[4:] == texts_[4:]
    mail = re.search(r"[\w.]+@[\w.]+", new[0]).group().rstrip(".")
    assert mail != "Jo.Doe@mail.acme.org" and re.fullmatch(r"[A-Z][a-z]\.[A-Z][a-z]{2}@[a-z]{4}\.acme\.org", mail) and mail.upper() in new[1]
    phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", new[0] + new[1])
    assert len(phones) == 2 and len(set(phones)) == 1 and "555-0187" not in new[0] + new[1]
    spaced, plain = re.search(r"Card (\d{4} \d{4} \d{4} \d{4}), also (\d{16});", new[2]).groups()
    assert spaced.replace(" ", "") == plain != "4" + "1" * 15 and pii.luhn(plain)
    assert "10.1.2.3" not in new[2] and re.search(r"key [0-9a-f]{26}$", new[2])
    first, family, again, third = re.fullmatch(r"Mrs\. (\w+) (\w+) met Herr (\w+) and Dr (\w+)\.", new[3]).groups()
    assert family == again == third != "Weber" and first.lower().endswith(tuple(pii.ENDINGS["latin", "female"]))
    for r in got.values():
        for s in r.pii_spans:
            assert 0 <= s.start < s.stop <= len(r.text)
    other = {r.doc_id: r.text for r in pii.replace_entities(docs, "another key").collect()}
    assert other[0] != new[0] and {r.doc_id: r.text for r in pii.replace_entities(docs, "k").collect()} == {i: t for i, t in enumerate(new)}


def test_surrogates_stay_distinct(spark):
    """More entities than surrogates would allow without checks: 4-letter mail names at one domain."""
    values = [f"{a}{b}1@x.org" for a in "bcdfghjklm" for b in "aeiou"]
    entities = spark.createDataFrame([("email", v) for v in values], "kind string, value string")
    table = pii.surrogate_table(entities, b"k").collect()
    made = {r.surrogate for r in table}
    assert len(table) == len(values) == len(made) and not made & set(values)


def test_surrogates_in_the_documents(spark, texts):
    rows = QUERIES["op1_pii_surrogates"](spark, FOLDER).collect()
    old = {e[2:] for t in texts.values() for e in pii.find_entities(t)}
    assert old and len(rows) == len(texts)
    for r in rows:
        assert not {e[2:] for e in pii.find_entities(r.text)} & old
        if not r.n_entities:
            assert r.text == texts[r.doc_id]


def test_every_entity_alone_in_a_text_is_found(spark):
    alone = ["a@b.co", "0123456789abcdef01234567", "8.8.8.8", "1.1.1.1", "192.168.10.20", "٨.٨.٨.٨", "4111111111111", "12 345678", "(12)345678", "+12345678",
             "٠٣٠ ٣٤٥ ٦٧٨٩", *[f"{t} Rolana" for t in pii.FEMALE_TITLES + pii.MALE_TITLES + pii.OTHER_TITLES]]
    assert all(pii.find_entities(t) for t in alone)
    docs = spark.createDataFrame(list(enumerate(alone)), "doc_id long, text string")
    assert {r.doc_id for r in pii.replace_entities(docs, "k").collect() if r.pii_spans} == set(range(len(alone)))


def test_pii_odd_input(odd_docs, no_docs):
    done = pii.replace_entities(odd_docs, "k")
    assert done.columns == odd_docs.columns + ["pii_spans"]
    assert sorted(map(repr, done.drop("pii_spans").collect())) == sorted(map(repr, odd_docs.collect()))
    assert pii.replace_entities(no_docs, "k").count() == 0


def test_packing_against_the_tokenizer(spark, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(WORD_BPE)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = packing.pack(docs, WORD_BPE, window=512).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    total = 0
    for i, t in texts.items():
        ids = model.encode(t, add_special_tokens=False).ids + [1]
        total += len(ids)
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.start for p in parts] == list(range(0, len(ids), 512)) and [p.piece for p in parts] == list(range(len(parts)))
        for p in parts:
            assert zlib.crc32(np.array(ids[p.start:p.start + p.length], dtype="<u4").tobytes()) == p.ids_crc32
    check_sequences([(r.sequence_id, r.offset, r.length) for r in rows], 512)
    assert len({r.sequence_id for r in rows}) <= total / 512 * 1.02 + 1


def test_encoder_on_hard_texts():
    from tokenizers import Tokenizer

    model, own = Tokenizer.from_file(WORD_BPE), packing.encoder(WORD_BPE)
    random.seed(9)
    parts = ["a", "Th", "e's", "'T", "'re", "'", "don't", " ", "\n", "\t", "É", "ß", "ÿ", "÷", "×", "é", "中", "😀", "<|endoftext|>", "<|", "1", "23", "½", "...", "!!", "\xa0", "\x85", "\x1c", "\x0b",
             "µ", "Ω", "ς", "İ", "</w>", "  ", "### ", "x@y.z", "\x00", "\x7f", "ﬁ"]
    tried = ["".join(random.choice(parts) for _ in range(random.randint(0, 20))) for _ in range(3000)]
    for text, ids in zip(tried, own.encode(tried)):
        assert ids.tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)


def check_sequences(rows, window):
    sequences = {}
    for s, o, n in rows:
        sequences.setdefault(s, []).append((o, n))
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= window


@pytest.mark.parametrize("window", [1, 7, 60, 1023])
def test_plans_place_every_piece_once(window):
    random.seed(window)
    for _ in range(30):
        counts = {random.randint(1, window): random.choice([1, 2, 3, 1000]) for _ in range(random.randint(1, 50))}
        rows = [(s + k, o, n, r + k) for n, r, c, s, o in packing.plan_ranges(counts, window) for k in range(c)]
        assert Counter(n for _, _, n, _ in rows) == counts and len({(n, r) for _, _, n, r in rows}) == len(rows)
        check_sequences([x[:3] for x in rows], window)


def test_exact_complements_are_used():
    counts = {60: 5, 40: 5, 50: 3, 30: 3, 20: 3, 25: 8}
    rows = [(s + k, n) for n, r, c, s, o in packing.plan_ranges(counts, 100) for k in range(c)]
    assert len({s for s, _ in rows}) == 10
    assert packing.plan_ranges({}, 100) == [] and len(packing.plan_ranges({3 * k: 1 for k in range(1, 1366)}, 4096)) == 1365


def test_packing_odd_input(odd_docs, no_docs):
    rows = packing.pack(odd_docs, WORD_BPE, with_ids=True).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in odd_docs.collect())
    assert {r.length for r in rows if r.doc_id in (3, 4, 7)} == {1} and max(r.piece for r in rows) > 10 and all(len(r.ids) == r.length for r in rows)
    check_sequences([(r.sequence_id, r.offset, r.length) for r in rows], 4096)
    assert packing.pack(no_docs, WORD_BPE).count() == 0


def test_prefix_counts_are_exact(texts):
    model = token_counts.counter(PIECES)
    random.seed(5)
    parts = ["a", "th", "e", " ", "  ", "\n", "é", "中", "😀", "<s>", "</s>", "<unk>", "<0x0A>", "▁", "1", "...", "http", "://", "\x00", "ion", "    ", "\r\n", "́"]
    tried = ["".join(random.choice(parts) for _ in range(random.randint(0, 24))) for _ in range(400)] + [t[:300] for t in list(texts.values())[:20]]
    for text, counts in zip(tried, model.prefix_counts(tried)):
        assert counts.tolist() == [len(model.model.encode(text[:k])) for k in range(1, len(text) + 1)], text


def test_token_counts_query(spark, texts):
    model = token_counts.counter(PIECES).model
    rows = QUERIES["op4_prefix_counts"](spark, FOLDER).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {
        (i, len(t.encode()), n := len(model.encode(t)), n > 4096) for i, t in texts.items()}


def test_token_budget_questions(odd_docs, no_docs):
    counted = token_counts.prefix_tokens(odd_docs, PIECES)
    rows = counted.select("doc_id", "n_tokens", token_counts.tokens_of_prefix(F.col("prefix_tokens"), 5).alias("five"),
                          token_counts.longest_prefix(F.col("prefix_tokens"), 10).alias("fits")).collect()
    model = token_counts.counter(PIECES).model
    assert len(rows) == odd_docs.count() and {(r.n_tokens, r.five, r.fits) for r in rows if r.doc_id in (3, 4)} == {(0, 0, 0)}
    one = next(r for r in rows if r.doc_id == 1)
    assert one.five == len(model.encode(PROSE[:5])) and one.fits == max(k for k in range(200) if len(model.encode(PROSE[:k])) <= 10)
    assert next(r for r in rows if r.doc_id == 5).n_tokens == len(model.encode(LONG)) and token_counts.prefix_tokens(no_docs, PIECES).count() == 0


def test_repeated_passages_against_brute_force(spark, texts):
    rows = {r.doc_id: r for r in QUERIES["op3_compact_windows"](spark, FOLDER).collect()}
    where = {}
    for i, t in texts.items():
        w = lowered(t)
        for k in range(len(w) - 49):
            where.setdefault(tuple(w[k:k + 50]), set()).add(i)
    want = groups([(a, b) for s in where.values() for a in s for b in s if a < b], texts)
    shared = {i for i, r in want.items() if Counter(want.values())[r] > 1}
    assert shared and shared <= set(rows)
    classes = {i: rows[i].class_id for i in shared}
    assert all(classes[i] == classes[want[i]] for i in shared)
    low = {i: " ".join(lowered(t)) for i, t in texts.items()}

    def share(i, j):
        a, b = passages.numbered_runs(low[i], low[j], 5)
        return passages.common_passages(a, b, 5, 50, 0.8) or passages.common_passages(b, a, 5, 50, 0.8)

    for i in set(rows) - shared:  # near copies only: some other document of the class must share a passage
        others = [j for j in rows if j != i and rows[j].class_id == rows[i].class_id]
        assert any(share(i, j) for j in others)


def test_near_passages_and_windows(spark):
    random.seed(6)
    word = lambda: "".join(random.choice("bdfglmnprstv") + random.choice("aeiou") for _ in range(random.randint(1, 4)))
    passage = [word() for _ in range(70)]
    edited = passage[:35] + ["changed"] + passage[36:]
    around = lambda p: " ".join([word() for _ in range(80)] + p + [word() for _ in range(90)])
    rows = [(1, around(passage)), (2, around(passage)), (3, around(edited)), (4, around([])), (5, around(passage[:30]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in passages.passage_classes(docs).collect()}
    assert set(found) == {1, 2, 3} and {r.class_id for r in found.values()} == {1}
    assert abs(found[2].first_word - 80) <= 1 and abs(found[2].last_word - 150) <= 1
    values = np.array([random.randrange(1000) for _ in range(300)], dtype=np.uint64)
    left, centre, right = passages.compact_windows(values, 20)
    for i in range(0, 280):  # every range of 20 tokens lies in exactly one window, around its smallest token
        inside = [(c, lo, hi) for lo, c, hi in zip(left, centre, right) if lo <= i <= c < i + 20 <= hi]
        assert len(inside) == 1 and values[inside[0][0]] == values[i:i + 20].min()


@pytest.mark.parametrize("sorted_windows", [5_000, 3])
def test_passages_of_texts_that_are_unlike_the_lead_of_their_meeting(spark, monkeypatch, sorted_windows):
    """A 40-word line is in all texts, so that they meet; pairs of them share a passage of 70 words around it."""
    monkeypatch.setattr(passages, "SORTED_WINDOWS", sorted_windows)  # larger meetings go by rows
    random.seed(11)
    word = lambda: "".join(random.choice("bdfglmnprstv") + random.choice("aeiou") for _ in range(random.randint(2, 5)))
    some = lambda n: [word() for _ in range(n)]
    line, rows = some(40), []
    for pair in range(40):
        passage = some(15) + line + some(15)
        rows += [(2 * pair + k, " ".join(some(60) + passage + some(60))) for k in (0, 1)]
    rows += [(100 + k, " ".join(some(60) + line + some(60))) for k in range(40)]
    found = {r.doc_id: r.class_id for r in passages.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: i - i % 2 for i in range(80)}


def test_passages_odd_input(odd_docs, no_docs):
    found = {r.doc_id: r.class_id for r in passages.passage_classes(odd_docs).collect()}
    assert found == {1: 1, 2: 1} and passages.passage_classes(no_docs).count() == 0


def test_quality_model_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op9_attention_quality"](spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged) and {b for _, b in judged} == {0, 1}


def test_quality_model_odd_input(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (3, 1), (99, 1), (None, 1), (2, None), (4, 0), (4, 1)], "doc_id long, quality int")
    model = quality_model.fit(odd_docs, labels)
    rows = quality_model.scores(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1 and quality_model.scores(no_docs, model).count() == 0
    with pytest.raises(ValueError):
        quality_model.fit(odd_docs, labels.filter("quality = 1"))


def test_gradients_lower_the_loss():
    rng = np.random.default_rng(3)
    bags = [rng.normal(0, 1, (int(rng.integers(1, 6)), 4)).astype(np.float32) for _ in range(200)]
    labels = np.array([int(b[:, 0].max() > 0.8) for b in bags])
    p = quality_model.predict(quality_model.train(bags, labels), bags)
    assert ((p > 0.5) == labels).mean() > 0.95


def test_windows_around_a_repeated_line_are_joined(spark):
    """Windows that overlap are one, those apart and those that would be too long stay, and of equal tokens one does."""
    far = passages.REACH
    pack = lambda left, right: int(passages._packed(*(np.array([v]) for v in (left, (left + right) // 2, right)))[0] | 3)
    windows = [(i, i + 60) for i in range(0, 500, 10)] + [(900, 960), (955, 1000)]
    rows = [(1, token, 7, pack(*w)) for token in (5, 6) for w in windows] + [(2, 5, 8, pack(i * far, (i + 1) * far + 10)) for i in range(3)]
    found = passages.joined_windows(spark.createDataFrame(rows, "meeting long, token long, doc long, place long")).collect()
    ranges = sorted((r.meeting, r.token, r.doc, (r.place >> 35) - ((r.place >> 19) & far), (r.place >> 35) + ((r.place >> 3) & far) + 1, r.place & 7) for r in found)
    assert ranges == [(1, 5, 7, 0, 550, 3), (1, 5, 7, 900, 1000, 3)] + [(2, 5, 8, i * far, (i + 1) * far + 10, 3) for i in range(3)]
