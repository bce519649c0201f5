"""The training-data operators against brute force, round trips and held-out labels."""

import collections
import hashlib
import json
import math
import re
import subprocess
import sys
import tarfile
import time
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridwell.llm import bpe, chat, common, htmltext, jaccard, media, mixing, quality, tokenbin, toxicity, urlfilter, wordhash
from gridwell.llm.common import Scratch, WordHashes
from gridwell.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "one", "a b c d e", "é   x", "x" * 20_000, "w " * 5_000, "a\nb\na\n\n\nb\n", "<|endoftext|>", "\x00 \x1c"]


def docs_of(spark, texts, **more):
    """documents with columns whose names the operators use themselves."""
    rows = [(k, t, "en", f"s{k % 3}" if k % 4 else None, len(t or ""), "row", k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, size long")


@pytest.fixture(scope="module")
def truth():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def test_tasks_follow_the_input(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert common.tasks(docs) == usual
    assert common.tasks(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "a int")) == usual  # of unknown size
    size = Path(f"{SF}/documents.parquet").stat().st_size
    monkeypatch.setattr(common, "BYTES_A_TASK", 10_000)
    assert common.tasks(docs.join(docs.select("doc_id"), "doc_id")) == 2 * size // 10_000
    with Scratch(spark) as scratch:
        monkeypatch.setattr(common, "BYTES_A_TASK", 30_000)
        files = scratch.table(tokenbin.written(docs, f"{scratch.root}/tokens"), "files")
        assert files.select("part").distinct().count() == size // 30_000


# -- 1


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = c.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted((tuple(r[x] for x in columns) for r in df.collect()), key=repr) == sorted((tuple(r[names.index(x)] for x in columns) for r in found.fetchall()), key=repr) or _close(df, columns, c.execute(oracle_sql()[name]).fetchall(), names)


def _close(df, columns, rows, names):
    norm = lambda r: tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r)
    return sorted(norm([r[x] for x in columns]) for r in df.collect()) == sorted(norm([r[names.index(x)] for x in columns]) for r in rows)


def test_mix_comes_near_its_targets(spark):
    rows = [(k, "w " * (1 + k * 7 % 90), ["a", "b", "c", None][k % 4 if k % 3 else 0]) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).select("row.source", "size", "source_size", "target", "copies").collect()
    total = sum(r["size"] for r in got)
    for source in ("a", "b", "c", None):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        assert own[0]["target"] <= 3 * own[0]["source_size"] + 1e-6
        assert all(0 <= r["copies"] <= 3 for r in own)
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(total)
    again = mixing.mix(docs.repartition(7)).select("row.doc_id", "copies").collect()
    assert {r["doc_id"]: r["copies"] for r in again} == {r["doc_id"]: r["copies"] for r in mixing.mix(docs).select("row.doc_id", "copies").collect()}


def test_mix_edges(spark):
    docs = docs_of(spark, ODD * 2)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert mixing.mix(docs).count() == len(ODD) * 2
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.mixed(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0


# -- 2


@given(st.text(max_size=300))
@settings(max_examples=60, deadline=None)
def test_png_holds_the_text(text):
    text = text.encode("utf-8", "ignore").decode()
    n, payload = media.padded(text)
    assert len(payload) % 64 == 0
    assert len(payload) >= max(64, n)
    png = media.to_png(payload)
    assert media.png_header(png[:33])[:2] == (64, len(payload) // 64)
    assert media.from_png(png).tobytes()[:n].decode() == text


def test_media_query(spark, truth):
    for r in queries()["op2_media"](spark, SF).collect():
        data = (truth[r["doc_id"]] or "").encode()
        full = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))


def test_shards_are_tar_files_with_each_payload_once(spark, tmp_path):
    with Scratch(spark) as scratch:
        folder = f"file://{tmp_path}/shards"
        index = scratch.keep(media.stored(docs_of(spark, ODD + ODD).coalesce(1), folder))
        rows = index.collect()
        names = [m.name for p in (tmp_path / "shards").glob("*.tar") for m in tarfile.open(p)]
        assert sorted(names) == sorted({f"{r['digest']}.png" for r in rows})
        assert len(rows) == 2 * len(ODD)
        assert media.with_features(media.with_metadata(index, folder), folder).count() == 2 * len(ODD)
        assert media.stored(docs_of(spark, ODD).limit(0), folder).count() == 0


# -- 3


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<|says|>"]), st.lists(st.sampled_from(["<", "|", "\\", "[INST]", "</s>", "<|end|>", "<|turn|>", "x", "\n", "<s", ">"]), max_size=8).map("".join)), max_size=5))
@settings(max_examples=200, deadline=None)
def test_turns_come_back(turns):
    text, spans = chat.formatted(turns)
    assert chat.parsed(text) == turns
    assert [chat._unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    for _, said in turns:
        assert not any(c in chat.escaped(said) for c in chat.CONTROLS)


def test_layouts(spark):
    turns = [("user", "q"), ("assistant", "a")]
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 3},
        {"instruction": "q", "input": "", "output": "a"}, {"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a", "extra": {"z": 1}}, {"turns": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]},
    ]
    for r in records:
        layouts = chat.Layouts()
        key, mapping = layouts.mapping(r)
        assert mapping.turns(r) == turns
        assert layouts.mapping(r)[0] == key
    assert chat.Layouts().mapping({"nothing": 1})[1] is None
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "{"), (4, "[1]"), (5, '{"prompt": "q", "completion": "a"}')], "conv_id long, record string")
    assert [r["n_turns"] for r in chat.format_records(rows).orderBy("conv_id").collect()] == [0, 0, 0, 0, 2]


@pytest.mark.parametrize(
    ("record", "turns"),
    [
        ({"messages": ["a"]}, [("", "a")]), ({"messages": [None]}, [("", "")]), ({"messages": [3, {"role": 7, "content": None}]}, [("", "3"), ("7", "")]),
        ({"messages": []}, []), ({"messages": None}, []), ({"messages": {"role": "user"}}, []), ([], []), ("x", []), ({"messages": [[["a"]]]}, [("", "a")]),
        ({"system": "s", "prompt": "q", "completion": "a"}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ({"system": "s", "messages": [{"role": "user", "content": "q"}]}, [("system", "s"), ("user", "q")]),
        ({"instruction": "q2", "input": "", "output": "", "history": [["q1", "a1"]]}, [("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("assistant", "")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "url": "u"}, "b"]}]}, [("user", 'a{"type": "image", "url": "u"}b')]),
        ({"messages": [{"role": "bot", "content": "q"}, {"role": "human", "content": "a"}]}, [("bot", "q"), ("human", "a")]),
        ({"prompt": [{"role": "user", "content": "q"}], "completion": [{"role": "assistant", "content": "a"}]}, [("user", "q"), ("assistant", "a")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "other", "value": "a"}]}, [("user", "q"), ("other", "a")]),
    ],
)
def test_records_of_any_shape(record, turns):
    out = chat.read_back(json.dumps(record), chat.Layouts())
    assert chat.parsed(out[0]) == turns
    assert out[4] == len(turns)


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["messages", "conversations", "turns", "role", "content", "from", "value", "text", "system", "history", "prompt", "completion", "instruction", "output"]), x, max_size=4), max_leaves=12))
@settings(max_examples=300, deadline=None)
def test_no_record_is_too_odd(record):
    assert chat.read_back(json.dumps(record), chat.Layouts())[4] >= 0


def test_deep_records_are_read_or_empty():
    layouts = chat.Layouts()
    for n in (500, 200_000):
        assert chat.read_back('{"messages": ' + "[" * n + "]" * n + "}", layouts)[4] in (0, 1)


def test_conversations_in_all_layouts(spark):
    """Every layout comes up, and each says the turns that went in."""
    rng = np.random.default_rng(2)
    rows, said = [], collections.defaultdict(list)
    for c in range(300):
        roles = [["user", "assistant"] * 3, ["system", "user", "assistant"], ["bot", "human"], ["user", "user"], ["", None]][c % 5]
        for t, role in enumerate(roles[: rng.integers(1, 7)] if c % 5 else roles[: 2 * rng.integers(1, 4)]):
            text = [None, "", "x\ny", "[INST]", '"q" \\', "\u00e9<|end|>"][rng.integers(0, 6)]
            rows.append((c, t, role, text))
            said[c].append((role or "", text or ""))
    rows += [(None, 1, "user", "b"), (None, None, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("record", F.lit("clash"))
    found = chat.format_records(chat.conversations(df)).collect()
    assert {r["layout"] for r in found} == {"messages", "shared", "turns", "prompt", "instruction"}
    assert len({r["fingerprint"] for r in found}) >= 6
    assert {r["conv_id"]: chat.parsed(r["formatted"]) for r in found} == said | {None: [("user", "a"), ("user", "b")]}
    assert chat.conversations(df.limit(0)).count() == 0


def test_chat_query(spark):
    said = collections.defaultdict(list)
    for c, t, r, x in duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall():
        said[c].append((t, r, x or ""))
    said[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    rows = queries()["op3_chat"](spark, SF).collect()
    assert len(rows) == len(said)
    for r in rows:
        turns = sorted(said[r["conv_id"]])
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()


# -- 4


@pytest.mark.parametrize("n", [0, 1, 5, 3000, 70_000])
def test_blocks_decode(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(max=60_000).astype(np.uint32)
    coder = tokenbin.Coder.of(ids).index().slots()
    data = coder.encode(ids)
    assert (coder.decode(data, n) == ids).all()
    if n > 100:
        broken = bytearray(data)
        broken[len(data) // 2] ^= 1
        try:
            assert (coder.decode(bytes(broken), n) != ids).any()
        except (ValueError, IndexError):
            pass


@pytest.mark.parametrize("counts", [[1], [1, 1], [10**9, 1, 1], [1] * 50_000, [0, 5, 0]])
def test_frequencies_fill_the_table(counts):
    f = tokenbin.scaled(np.array(counts))
    assert f.sum() == 1 << tokenbin.BITS
    assert ((f > 0) == (np.array(counts) > 0)).all()


def test_token_files(spark, truth):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenbin.default_path())
    got = {r["doc_id"]: r for r in queries()["op4_token_files"](spark, SF).collect()}
    start = 0
    for d in sorted(truth):
        ids = np.array([*library.encode(truth[d] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_parts():
    library = tokenbin.tokens(tokenbin.default_path())
    rng = np.random.default_rng(1)
    parts = ["a", " ", "  ", "\n", "\t", "'s", "'LL", "é", "_", "-.", "\r\n", "²", "日", "　", "\x1c", "<|endoftext|>", "7", "\x85", "Σς", "😀"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(3000)] + [t or "" for t in ODD]
    for t in texts:
        assert np.frombuffer(library.encode(t), "<u4").tolist() == library.library.encode(t, add_special_tokens=False).ids


def test_token_edges(spark):
    docs = docs_of(spark, ODD)
    with Scratch(spark) as scratch:
        files = scratch.table(tokenbin.written(docs, f"{scratch.root}/t"), "files")
        rows = tokenbin.read_back(files, f"{scratch.root}/t").collect()
    assert len(rows) == len(ODD)
    assert min(r["n_tokens"] for r in rows) == 1
    with Scratch(spark) as scratch:
        files = scratch.table(tokenbin.written(docs.limit(0), f"{scratch.root}/t"), "files")
        assert tokenbin.read_back(files, f"{scratch.root}/t").count() == 0


# -- 5


def test_toxicity_on_held_out_labels(spark):
    rng = np.random.default_rng(5)
    plain, bad = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)], ["idiot", "scum", "moron"]
    rows, labels = [], []
    for k in range(3000):
        words = list(rng.choice(plain, 60))
        toxic = rng.random() < 0.1
        if toxic:
            words[::20] = rng.choice(bad, 3)
        rows.append((k, " ".join(words)))
        if k % 2 == 0:
            labels.append((k, 1, int(toxic)))
    docs, labels_ = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels_)
    got = {r["doc_id"]: r for r in toxicity.scored(docs, model, ["doc_id"]).collect()}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    held = [(k, t) for k, _, t in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum(got[k]["predicted"] == t for k, t in held) >= 0.97 * len(held)
    assert 2500 < toxicity.kept(docs, labels_).count() < 2900
    empty = docs_of(spark, ODD)
    assert toxicity.scored(empty, model, ["doc_id", "row"]).count() == len(ODD)
    assert toxicity.kept(empty, labels_.limit(0)).count() == len(ODD)
    assert toxicity.kept(empty.limit(0), labels_).count() == 0


def buckets_of(t):
    return toxicity.features(np.frombuffer(t.encode(), np.uint8))


def test_toxicity_counts_every_document(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_UNLABELLED", 20)
    found, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda *a: found.append(a) or train(*a))
    counts, sureness = [], toxicity.sureness
    monkeypatch.setattr(toxicity, "sureness", lambda *a: counts.append(a) or sureness(*a))
    n = 300
    docs = spark.createDataFrame([(k, f"same word{'abcdefghij'[k % 10]}", "x") for k in range(n)] + [(None, "same", "x"), (n, None, "x")], "doc_id long, text string, bucket string").repartition(3)
    labels = spark.createDataFrame([(k, 1, int(k % 10 == 0)) for k in range(n)] * 2, "doc_id long, quality int, toxic int")
    toxicity.fit(docs, labels)
    (positive, n_positive), (everything, n_all) = counts.pop()
    texts = {k: f"same word{'abcdefghij'[k % 10]}" for k in range(n)}
    wanted = [texts[k] for k in range(n) if k % 10 == 0 and zlib.crc32(str(k).encode()) % 4 != 2]
    of = lambda ts: sum(np.bincount(buckets_of(t), minlength=toxicity.BUCKETS) for t in ts)
    assert n_positive == len(wanted)
    assert n_all == n + 2
    assert (positive == of(wanted)).all()
    assert (everything == of([*texts.values(), "same"])).all()
    assert len(found[0][1]) == 20


def test_words_that_begin_alike():
    """What begins alike in two or three words has features of its own."""
    one, two, three = (set(buckets_of(t).tolist()) for t in ("lowex", "lowex; Lowey lowey", "lowex lowey lowez"))
    base = 1 << toxicity.BITS
    assert one < two < three
    assert not any(x >= base for x in one)
    assert sum(base <= x < 2 * base for x in two) == 1  # of the first four letters
    assert sum(x >= 2 * base for x in three) == 1
    assert len(buckets_of("")) == 0
    assert len(buckets_of("w " * 200_000)) == 1  # over several pieces


def test_toxicity_risk_against_brute_force():
    """The risk that the steps go down is the non-negative one: of its two parts
    the gradient agrees with finite differences of a plainly written estimator."""
    rng = np.random.default_rng(0)
    docs = [(np.array(sorted(rng.choice(6, rng.integers(0, 4), replace=False)), np.int32), 5) for _ in range(40)]
    positive, unlabelled, scale, prior = docs[:10], docs[10:], np.ones(6), 0.3

    def risk(w, b):
        z = lambda side: np.array([b + sum(w[k] for k in d) / n**toxicity.ROOT for d, n in side])
        as_positive = prior * np.log1p(np.exp(-z(positive))).mean()
        negative = np.log1p(np.exp(z(unlabelled))).mean() - prior * np.log1p(np.exp(z(positive))).mean()
        return as_positive + max(0.0, negative)

    w, b = toxicity.train(positive, unlabelled, scale, prior)
    at = risk(w, b)
    assert at < risk(np.zeros(6), 0.0)
    grid = [(d * 0.05, s) for d in np.eye(7) for s in (1, -1)]
    assert all(at <= risk(w + s * d[:6], b + s * d[6]) + 5e-3 for d, s in grid)  # nearly a minimum


@pytest.mark.parametrize(("scale", "recall", "false"), [("0.01", 0.6, 0.03), ("0.1", 0.93, 0.01)])
def test_toxicity_on_held_out_documents(spark, scale, recall, false):
    """Held-out labels. At the smaller scale half of what is missed has two German
    examples to be learnt from and half no word that any toxic text has."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf{scale}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.scored(docs, toxicity.fit(docs, labels), ["doc_id"]).join(labels, "doc_id").filter(~toxicity.training_fold()).collect()
    caught = [r["predicted"] for r in rows if r["toxic"] == 1]
    assert sum(caught) >= recall * len(caught)
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(clean) <= false * len(clean)


# -- 6


def article(*paragraphs):
    return "<article><h1>Head</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("a < b", "a < b"), ("<body><p>Unclosed <b>bold", "Unclosed bold"),
        (article("One &amp; two,\n  three.", "x<br>y"), "Head\n\nOne & two, three.\n\nx y"),
        ("<nav><a>n</a></nav><div class='ad'>Buy this, now.</div>" + article("Text, here.") + "<footer>&copy; f</footer>", "Head\n\nText, here."),
        ("<style>p{}</style><script>var a='</p>'</script><!-- <p>no</p> -->" + article("Yes."), "Head\n\nYes."),
        (article("Some text, at length, so it is.") + "<section id='comments'><p>First, I say, and more, much more than that.</p></section><aside><p>Other.</p></aside><form><label>l</label></form>", "Head\n\nSome text, at length, so it is."),
        ("<div class='cookie-notice'>We use cookies.</div><div class='content has-sidebar'><h2>T</h2><p>Long, long text. It goes on.</p><ul><li>i</li></ul></div><div class='sidebar'><p>Side text, also long. Yes.</p></div>", "T\n\nLong, long text. It goes on.\n\ni"),
        ("<article><p>cut &am", "cut &am"), ("<div hidden>no</div><p>yes, here</p>", "yes, here"), ("<nav>only</nav>", ""),
    ],
)
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p>Long sentence one. <span class="ad">Buy</span> Rest.</p>', "Long sentence one. Rest."),
        ('<article><h1>Title <a class="share">s</a></h1><p>Text, and more.</p></article>', "Title\n\nText, and more."),
        ('<h1>Title <a class="share">s</a></h1><p>Text, and more.</p>', "Title\n\nText, and more."),
        ("<article><p>One <span hidden>no</span>two <i class='fa fa-share'>i</i>three <label>l</label>four.</p></article>", "One two three four."),
        ("<article><p>One <span class='share'><span>a</span> b</span>two.</p></article>", "One two."),
        ("<article><p>Never closed <span class='ad'>Buy</p><p>Next <b>one</b>.</p></article>", "Never closed\n\nNext one."),
        ("<article><div>Before <a class='share'>t<div>in</div>u</a> after.</div></article>", "Before\n\nafter."),
    ],
)
def test_text_around_other_inline_elements(page, text):
    assert htmltext.main_text(page) == text


POST = "<h1>Headline of it</h1>" + "<p>A sentence, and one more. It goes on, at length, as texts do.</p>" * 3
POST_TEXT = "\n\n".join(["Headline of it"] + ["A sentence, and one more. It goes on, at length, as texts do."] * 3)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<html><head><meta charset=utf-8><title>t</title><body>{POST}", POST_TEXT),
        (f"<head><title>t</title><link rel=x><div class=post>{POST}</div>", POST_TEXT),
        ("<head><title>t</title>Text alone, here.", "Text alone, here."),
        ("<head><title>t</title><noscript><meta x></noscript><style>p{}</style></head><p>Text, here.", "Text, here."),
        (f"<body><form id=aspnetForm><div class=menu><a>m</a></div><div class=x>{POST}</div></form>", POST_TEXT),
        (f'<body><div class="layout sidebar-right"><div class="sidebar"><p>Side, text.</p></div><div>{POST}</div></div><footer>(c) 2024 F.</footer>', POST_TEXT),
        (f'<body><div class="top"><p>An intro, which is here, too. Yes.</p></div><div class="hentry category-social">{POST}</div>', None),
        (f'<form><div class="hentry tag-ads">{POST}<div id=comments>{"<p>First, I say.</p>" * 20}</div></div></form>', POST_TEXT),
        (f"<div class=post>{POST}</div><div id=comments>{'<p>First, I say. And more.</p>' * 40}</div>", POST_TEXT),
        (f"<div class='post tag-social'>{POST}</div><div id=comments>{'<p>First, I say. And more.</p>' * 40}</div>", POST_TEXT),
        (f"<article>{POST}</article><div class=comments>{'<p>Longer, longer, longer, I say, and more, much more than that.</p>' * 40}</div>", POST_TEXT),
        (f"<article><h1>Headline of it</h1><div class='entry tag-share'>{POST[23:]}</div></article>", POST_TEXT),
        (f"<body><form><div hidden>{POST}</div></form><p>Text, here.", "Text, here."), ('<div role="navigation">only</div>', ""),
    ],
)
def test_words_hold_for_parts(page, text):
    got = htmltext.main_text(page)
    assert got == text if text is not None else got.endswith(POST_TEXT)


LONG = ("A sentence, of some length, which goes on here. " * 9)[:399] + "."
ITEMS = "".join(f"<li>An item of thirty letters, {k:02}</li>" for k in range(4))


def lines(*parts):
    return "\n\n".join(" ".join(p.split()) for p in parts)


@pytest.mark.parametrize("foot", ["<footer>f</footer>", "<div class=end>(c) F</div>"])
@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class=post><h1>{'x' * 30}</h1><div class=meta>by A</div><div class=entry>{f'<p>{LONG}</p>' * 10}</div></div>", ["x" * 30, "by A", *[LONG] * 10]),
        (f"<div class=top><p>Top</p></div><div class=post><div class=t><h2>Head</h2></div><div class=entry>{f'<p>{LONG}</p>' * 10}</div></div>", ["Head", *[LONG] * 10]),
        (f"<div class=box><h2>Box</h2><p>b</p></div><div class=entry><h2>Own</h2>{f'<p>{LONG}</p>' * 10}</div>", ["Own", *[LONG] * 10]),
        (f"<h1>Head</h1>{f'<p>{LONG}</p>' * 6}<h4>List</h4><ul>{ITEMS}</ul>", ["Head", *[LONG] * 6, "List", *re.findall("<li>(.*?)</li>", ITEMS)]),
        (f"<h1>Head</h1><p>{LONG}<p>Yes.<table><tr><td>1<td>2</table>{f'<p>{LONG}</p>' * 6}", ["Head", LONG, "Yes.", "1", "2", *[LONG] * 6]),
        (f"<div class=a><h1>Head</h1>{f'<p>{LONG}</p>' * 6}<ul>{ITEMS}</ul></div><div class=b>{f'<p>{LONG}</p>' * 6}<ul><li>i</ul></div>", ["Head", *[LONG] * 6, *re.findall("<li>(.*?)</li>", ITEMS), *[LONG] * 6, "i"]),
    ],
)
def test_article_is_whole(page, text, foot):
    assert htmltext.main_text(f"<html><body>{page}{foot}</body></html>") == lines(*text)


def plain_pages():
    """(page, text) of real pages: their articles, cut out by hand."""
    import html as entities

    for _, page in duckdb.sql(f"SELECT page_id, html FROM '{SF.replace('0.001', '0.01')}/pages.parquet' ORDER BY page_id").fetchall():
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        parts = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("<h1>|</h1>|<p>|</p>", inner)]
        yield page, "\n\n".join(p for p in parts if p)


def neutral(page):
    """The page without a tag or name that says what its parts are."""
    page = re.sub("(</?)(article|nav|footer)", r"\1div", page)
    return re.sub('class="ad"', 'class="k"', page)


def test_ratios_find_the_article(monkeypatch):
    """On pages without telling tags and names, nearly all by ratios alone; by
    equal ratios for all paths, hardly any."""
    pages = list(plain_pages())
    assert all(htmltext.main_text(p) == t for p, t in pages)
    right = [htmltext.main_text(neutral(p)) == t for p, t in pages]
    assert sum(right) >= 0.96 * len(pages)
    monkeypatch.setattr(htmltext, "OTHER", frozenset())
    monkeypatch.setattr(htmltext, "BESIDE", frozenset())
    assert [htmltext.main_text(neutral(p)) == t for p, t in pages] == right
    monkeypatch.setattr(htmltext, "ratios", lambda page, seen: np.ones(len(seen)))
    assert sum(htmltext.main_text(neutral(p)) == t for p, t in pages) < 0.1 * len(pages)


def test_a_threshold_on_ratios_decides(monkeypatch):
    """An article that stands in the body ends with its last content node: without a threshold, the foot is one."""
    page = f"<body><h1>Head</h1>{f'<p>{LONG}</p>' * 6}<div>(c) F.</div></body>"
    assert htmltext.main_text(page) == lines("Head", *[LONG] * 6)
    monkeypatch.setattr(htmltext, "LEAST", 0.0)
    assert htmltext.main_text(page) == lines("Head", *[LONG] * 6, "(c) F.")


@pytest.mark.parametrize("piece", ["<div>x, y. ", "<b>x ", "<center>x", "<ul><li>x, ", "<p><span class=ad>x", "<div class=ad>x, y. ", "<li>x", "<h2>x<div>", "</div><a>", "<td>x", "&lt;", "<"])
def test_deep_pages(piece):
    began = time.process_time()
    for n in (20_000, 60_000):
        assert htmltext.main_text(piece * n) is not None
    assert time.process_time() - began < 20


def test_pages(spark):
    rows = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    import html as entities

    wanted = {}
    for k, page in rows:
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        parts = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("<h1>|</h1>|<p>|</p>", inner)]
        wanted[k] = "\n\n".join(p for p in parts if p)
    got = queries()["op6_html_text"](spark, SF).collect()
    assert {r["page_id"]: r["text"] for r in got} == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in got)


# -- 7


def brute(texts: dict) -> dict:
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    sets = {}
    for k, t in texts.items():
        w = WORD.findall((t or "").translate(lower))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    keys = sorted(sets)
    where, n = collections.defaultdict(list), np.array([len(sets[k]) for k in keys])
    for i, k in enumerate(keys):
        for x in sets[k]:
            where[x].append(i)
    both = np.zeros((len(keys), len(keys)), np.int32)
    for at in where.values():
        if len(at) > 1:
            both[np.ix_(at, at)] += 1
    linked = (100 * both >= 75 * (n[:, None] + n[None] - both)) & (both > 0)
    found = {}
    for i, k in enumerate(keys):  # ascending, so a component is met at its least key
        if k not in found:
            reached, new = np.zeros(len(keys), bool), [i]
            while len(new):
                reached[new] = True
                new = np.flatnonzero(linked[new].any(0) & ~reached)
            found |= {keys[j]: k for j in (*np.flatnonzero(reached), i)}
    return {k: (len(sets[k]), found[k]) for k in keys}


def joined(spark, texts: dict):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    with Scratch(spark) as scratch:
        return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar(docs, scratch).collect()}


def test_join_against_brute_force(spark):
    rng = np.random.default_rng(7)
    word = lambda n: list(rng.choice([f"w{k}" for k in range(2000)], n))
    passage, texts = word(40), []
    base = word(120)
    for _ in range(60):  # near copies at all distances around the threshold
        t = list(base)
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            t[at] = f"e{rng.integers(10**6)}"
        texts.append(t)
    for _ in range(60):  # only a passage in common, in texts of all lengths
        texts.append(word(rng.integers(0, 60)) + passage + word(rng.integers(0, 60)))
    for _ in range(40):  # mostly the passage: some are similar, some not
        texts.append(passage + word(rng.integers(0, 12)))
    for _ in range(30):  # chains
        texts.append(base[rng.integers(0, 30) :] + word(3))
    texts += [word(n) for n in range(12)] + [["a", "b"], ["A", "b"], ["a", "b", "c", "d", "e"]]
    said = {int(k): " ".join(t) for k, t in enumerate(texts)}
    said |= {len(said) + k: t for k, t in enumerate(ODD)}
    said |= {len(said) + k: said[k] for k in range(20)}
    assert joined(spark, said) == brute(said)


def test_join_within_one_group(spark):
    """Two similar texts that share their prefix and size with a third, dissimilar one, which stands for the three."""
    rng = np.random.default_rng(5)
    limit = np.uint64(2**64 // 5)

    def grown(words: list, n: int, low: bool) -> list:
        """n more words, so that the hash of each shingle that they end is low or isn't."""
        words = list(words)
        for _ in range(n):
            while True:
                w = f"w{rng.integers(10**9)}"
                if len(words) < 4 or (jaccard.shingles(np.frombuffer(" ".join([*words[-4:], w]).encode(), np.uint8))[0] < limit) == low:
                    break
            words.append(w)
        return words

    key = lambda t: jaccard.set_key(jaccard.shingles(np.frombuffer(" ".join(t).encode(), np.uint8)))
    begin = grown([], 10, True)  # six shingles, the whole prefix of texts of 20
    one = grown(begin, 14, False)
    two = grown(one[:-1], 1, False)
    other = grown(begin, 14, False)
    while key(other) > min(key(one), key(two)):
        other = grown(begin, 14, False)
    said = {k: " ".join(t) for k, t in enumerate((other, one, two))}
    docs = spark.createDataFrame(spark.sparkContext.parallelize(list(said.items()), 3), "doc_id long, text string")  # no task sees a shingle twice
    with Scratch(spark) as scratch:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar(docs, scratch).collect()}
    assert got == brute(said) == {0: (20, 0), 1: (20, 1), 2: (20, 1)}


def test_join_of_crowded_lists_makes_few_rows(spark):
    """Texts that their bitmaps can't tell apart: fewer links come out than there are rows, and none is lost."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(24)]
    texts = []
    for _ in range(300):
        t = list(base)
        t[int(rng.integers(0, 24))] = f"e{rng.integers(60)}"
        texts.append(t[: int(rng.integers(20, 25))])
    said = {k: " ".join(t) for k, t in enumerate(texts)}
    sets = {t: jaccard.shingles(np.frombuffer(t.encode(), np.uint8)) for t in said.values()}
    rows = [("L", jaccard.set_key(s), len(s), jaccard.set_key(s), t, jaccard.bitmap(s)) for t, s in sets.items()]
    table = spark.createDataFrame([(1, c, n, k, t, bytearray(b)) for _, c, n, k, t, b in rows], "list long, component long, n long, set_key long, text string, bits binary")
    left = jaccard.between(table.withColumn("total", F.lit(len(rows))), True, 4).collect()
    assert [tuple(r) for r in left] == [(1, None, -1)]
    links = [tuple(r) for r in jaccard.joining(table.drop("bits"), 4).collect()]
    assert len(links) < len(rows)
    root = {r[1]: r[1] for r in rows}
    for a, b in links:
        x, y = root[a], root[b]
        root = {k: x if v == y else v for k, v in root.items()}
    found = brute({k: t for k, t in enumerate(sets)})
    of = [root[jaccard.set_key(s)] for s in sets.values()]
    assert all((of[i] == of[j]) == (found[i][1] == found[j][1]) for i in range(len(of)) for j in range(i))


def test_sizes_of_crowded_lists_come_with_them(spark, monkeypatch):
    """Rows of lists aren't counted and joined once more where their texts come together."""
    rng = np.random.default_rng(12)
    texts = []
    for _ in range(400):
        t = [f"w{k}" for k in range(24)]
        for _ in range(3):
            t[int(rng.integers(0, 24))] = f"e{rng.integers(60)}"
        texts.append(" ".join(t))
    plans, real, small = [], jaccard.joining, jaccard.between

    def seen(rows, parts):
        of = rows.groupBy("list").agg(F.count("*").alias("m"), F.sum("n").alias("e"), F.min("total").alias("total"), F.max("elements").alias("elements"))
        assert of.filter("m <> total OR e <> elements").count() == 0
        there = spark.createDataFrame(rows.collect(), rows.schema)
        plans.append(real(there, parts)._jdf.queryExecution().optimizedPlan().toString())
        return real(rows, parts)

    monkeypatch.setattr(jaccard, "joining", seen)
    # every list that has pairs of components counts as crowded
    monkeypatch.setattr(jaccard, "between", lambda rows, every, parts: rows.select(F.col("list").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(-1).cast("long").alias("score")) if every else small(rows, every, parts))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    with common.Scratch(spark) as scratch:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar(docs, scratch).collect()}
    assert plans and not any("Join" in p for p in plans)
    assert got == brute(dict(enumerate(texts)))


def test_join_edges(spark):
    docs = docs_of(spark, ODD)
    with Scratch(spark) as scratch:
        assert jaccard.similar(docs.limit(0), scratch).count() == 0
    once = jaccard.kept(docs.union(docs))
    assert once.columns == docs.columns
    assert once.count() == docs.count()
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert jaccard.kept(nulls).count() == docs.count()


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=400), st.sets(st.integers(0, 2**64 - 1), max_size=400))
@settings(max_examples=80, deadline=None)
def test_bitmaps_never_rule_out_a_link(a, extra):
    one = np.array(sorted(a), np.uint64)
    keep = one[: max(1, int(len(one) * 0.9))]
    two = np.unique(np.append(keep, np.array(sorted(extra), np.uint64)[: len(one) // 8]))
    x, y = (np.frombuffer(jaccard.bitmap(s), np.uint8)[None] for s in (one, two))
    w = min(x.shape[1], y.shape[1])
    x, y = jaccard.folded(x, w), jaccard.folded(y, w)
    both = len(np.intersect1d(one, two))
    assert jaccard.most_shared(np.array([len(one)]), x, np.array([len(two)]), y)[0] >= both


def test_join_of_a_passage_in_thousands(spark, monkeypatch):
    """One passage and one text's near copies in 5,000 documents, with long lists
    dealt out, stars and cells cut far below their usual size."""
    for name, value in (("HOT", 200), ("SPOKES", 64), ("BLOCK", 300)):
        monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 50_000, n)]
    passage, base, texts = word(60), word(60), []
    for _ in range(3800):  # most of the text is the passage: some are similar, most are not
        texts.append(word(rng.integers(0, 5)) + passage + word(rng.integers(0, 30)))
    for _ in range(1200):  # at all distances around the threshold
        t = list(base)
        for at in rng.choice(60, rng.integers(0, 4), replace=False):
            t[at] = f"e{rng.integers(10**6)}"
        texts.append(t)
    said = {int(k): " ".join(t) for k, t in enumerate(texts)}
    assert joined(spark, said) == brute(said)


@given(st.lists(st.sampled_from(["a", "B", "\u00e9", " ", "\n", "\x0b", "\x1c", "xyz", "w" * 70, "K" * 40]), max_size=60))
@settings(max_examples=200, deadline=None)
def test_word_hashes(parts):
    raw = np.frombuffer("".join(parts).encode(), np.uint8)
    alone = [int(wordhash.word_hashes(np.frombuffer(w, np.uint8))[0]) for w in raw.tobytes().lower().split()]
    assert wordhash.word_hashes(raw).tolist() == alone


def test_long_texts_go_in_pieces():
    """However pieces fall, a text's words have the hashes that they have alone."""
    text = " ".join(f"Word{k}" + "\u00e9" * (k % 7) for k in range(60_000)) + " " + "x" * 300_000 + " end"
    got = wordhash.word_hashes(np.frombuffer(text.encode(), np.uint8)).tolist()
    words = [np.frombuffer(w, np.uint8) for w in text.encode().lower().split()]
    assert len(got) == len(words)
    assert all(got[k] == int(wordhash.word_hashes(words[k])[0]) for k in (*range(0, 60_000, 997), 60_000, 60_001))


def test_workers_of_the_join_stay_small():
    """What a worker holds beside its imports while it hashes, counts and deals out postings."""
    code = """
import resource, numpy as np, pyarrow as pa
from types import SimpleNamespace
from gridwell.llm import jaccard, wordhash
class Frame:
    schema = {"doc_id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))}
    def select(self, *_): return self
    def mapInArrow(self, run, _): self.run = run; return self
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rng = np.random.default_rng(1)
jaccard.of_text = lambda c: c
def batches(keys):
    for k in range(40):
        texts = pa.array([" ".join(map(str, rng.integers(0, 10**6, 400))) for _ in range(250)])
        yield pa.RecordBatch.from_arrays(([pa.array(range(250))] if keys else []) + [texts], names=(["doc_id"] if keys else []) + ["text"])
f = Frame(); jaccard.keyed_sets(f, "text", "doc_id"); n = sum(b.num_rows for b in f.run(batches(True)))
order = jaccard.Order.of(np.sort(rng.integers(0, 2**63, jaccard.FREQUENT).astype(np.uint64)), np.full(jaccard.FREQUENT, 9))
f = Frame(); jaccard.postings(f, SimpleNamespace(value=order), "text", 800); n += sum(b.num_rows for b in f.run(batches(False)))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=Path(jaccard.__file__).parents[2])
    assert float(out.stdout) < 120


# -- 8


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/7?x", "http://a.com/en/", "http://com/en/x", "http://xcom/en/x", "https://a.b.net/de/8#y", "https://a.example.net/de/8", "ftp://x.org/es/", "https://blog.cheap-pills.example.net/fr/1", "http://h?q=://z", "http://a.net/x?affiliate_id=7"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit("old"))
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(rows).orderBy("page_id").collect()]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("example.com", "/en/7", "example.com/en/7", "allow"), ("a.com", "/en/", "com/en/", "block"), ("com", "/en/x", "com/en/", "block"),
        ("xcom", "/en/x", None, "allow"), ("a.b.net", "/de/8", "net/de/", "allow"), ("a.example.net", "/de/8", "example.net/de/8", "block"), ("x.org", "/es/", "org/es/", "block"),
        ("blog.cheap-pills.example.net", "/fr/1", None, "block"), ("h", "", None, "allow"), ("a.net", "/x", None, "block"),
    ]
    assert urlfilter.judge(rows.limit(0)).count() == 0
    for literal, rule in urlfilter.rarest(rows, "url", urlfilter.PATTERN_RULES):
        assert any(literal in x for x in rule.sets())


def test_url_rules_alternatives(spark):
    block = ["http://a.net/xxx/1", "http://a.net/porn/1", "http://a.net/x?aff_id=1", "http://a.net/x?affiliate_id=1"] + [f"http://{a}-{b}.net/" for a, b in (("cheap", "pills"), ("free", "bets"), ("casino", "win"), ("adult", "x"), ("spam", "farm"), ("ads", "track"))]
    allow = [f"http://a.net/xxx/{a}.{b}" for a in ("robots", "sitemap") for b in ("txt", "xml")]
    for more in ([], ["http://robots/xml/"] * 9, ["http://txt/sitemap/"] * 9, ["http://xml/txt/"] * 9):  # whatever is the rarest
        rows = spark.createDataFrame([(x,) for x in [*block, *allow, *more]], "url string")
        got = {r["url"]: r["verdict"] for r in urlfilter.judge(rows).collect()}
        for urls, verdict in ((block, "block"), (allow, "allow")):
            assert [got[u] for u in urls] == [verdict] * len(urls)
    for r in urlfilter.PATTERN_RULES:  # every URL of a rule has all literals of one of its alternatives
        for u in [u for u in [*block, *allow] if re.search(r.regex.replace(r"\z", r"\Z"), u)]:
            assert any(set(x) <= set(re.split("[^a-z0-9]+", u)) for x in r.sets())


def test_url_rules_must_show_their_literals():
    for regex, literals in ((r"[/?](porn|xxx)[/?]", ("porn",)), (r"porn", ("porn",)), (r"/porn?/", ("porn",)), (r"/(porn)*/", ("porn",)), (r"/porn[/a]", ("porn",)), (r"/.*/x/", ("y",)), (r"/a/", ())):
        with pytest.raises(ValueError):
            urlfilter.PatternRule("block", regex, literals)
    for regex, literals, others in ((r"[/?](porn|xxx)[/?]", ("porn",), (("xxx",),)), (r"/porn+/x/", ("x",), ()), (r"\bfree-bets\b", ("free", "bets"), ()), (r"/a(b|c)?\z", ("a",), (("ab",), ("ac",)))):
        urlfilter.PatternRule("block", regex, literals, others)


def test_url_index_against_all_rules(spark, monkeypatch):
    """Random URLs of the rules' own pieces: the index gives what running every rule on every URL gives, by literals and by tables."""
    rng = np.random.default_rng(5)
    pieces = ["cheap", "pills", "free", "bets", "casino", "win", "adult", "x", "spam", "farm", "ads", "track", "porn", "xxx", "aff", "affiliate", "id", "robots", "sitemap", "txt", "xml", "com", "net", "org", "example", "en", "de", "es", "7", "8", "\u00e9", "\n"]
    urls = {"".join(["http://" if rng.random() < 0.9 else "", *(x + rng.choice(list("-./?&=_#:") + [""], p=[0.2, 0.2, 0.2] + [0.4 / 7] * 7) for x in rng.choice(pieces, rng.integers(1, 8)))]) for _ in range(6000)}
    rows = [(k, u) for k, u in enumerate(sorted(urls))] + [(-1, None), (-2, "http://a-cheap-pills.net/" + "a/" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    c = duckdb.connect()
    c.register("pages", pages.toArrow())
    wanted = sorted(map(str, c.execute(urlfilter.OP8_SQL).fetchall()))
    assert {"block", "allow"} == {r[-1] for r in c.execute(urlfilter.OP8_SQL).fetchall()}
    for most in (urlfilter.MOST_RULES, 2):
        monkeypatch.setattr(urlfilter, "MOST_RULES", most)
        got = urlfilter.judge(pages).select("page_id", "host", "path", "rule", "verdict")
        assert sorted(str(tuple(r)) for r in got.collect()) == wanted


# -- 9


def test_bpe_is_the_librarys(spark, truth):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(bpe.default_path()), bpe.word_bpe(bpe.default_path())
    rng = np.random.default_rng(2)
    texts = [t or "" for t in (*truth.values(), *ODD)] + ["".join(rng.choice(list("etaonish"), rng.integers(1, 60))) for _ in range(500)]
    texts += ["x" + chr(c) + "Y" + chr(c) + " " + chr(c) + "s" for c in range(0x3000) if not 0xD800 <= c < 0xE000] + ["<|startoftext|>A's ΑΣ İ", "!?" * 500, "ab" * 900]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        mine = np.frombuffer(own.encode(t), "<u4")
        assert mine.tolist() == ids, t
        assert own.decode(mine).decode() == library.decode(ids, skip_special_tokens=False)
    assert bpe.encoded(docs_of(spark, ODD)).count() == len(ODD)
    assert bpe.digested(docs_of(spark, ODD).limit(0)).count() == 0


# -- 10


def counts_of(t: str):
    w = WORD.findall(t)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    in_ = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, dup = set(), 0
    for line in t.split("\n"):
        dup += line in lines and bool(WORD.search(line))
        lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(in_)


def test_quality_counts(truth):
    hashes = WordHashes()
    rng = np.random.default_rng(4)
    texts = [t or "" for t in (*truth.values(), *ODD)] + [" ".join(rng.choice(["a", "b"], rng.integers(0, 40))) for _ in range(200)]
    for t in texts:
        assert quality.base_counts(t, hashes)[0] == counts_of(t)


def test_quality_verdicts(spark, truth):
    got = {r["doc_id"]: r for r in queries()["op10_quality_rules"](spark, SF).collect()}
    assert set(got) == set(truth)
    for r in got.values():
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_quality_model_against_brute_force(spark, truth):
    """Counts, ratios, scores and threshold, written plainly."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    fold = lambda k: zlib.crc32(str(k).encode()) % 4 == 3
    grams = {k: quality.buckets(WordHashes().of(WORD.findall(t or ""))).tolist() for k, t in truth.items()}
    raw, target = collections.Counter(), collections.Counter()
    for k, g in grams.items():
        raw.update(g)
        if k in good and not fold(k):
            target.update(g)
    n, (all_raw, all_target) = 1 << quality.BITS, (sum(raw.values()), sum(target.values()))

    def ratio(x):
        p = (raw[x] + 1) / (all_raw + n)
        return math.log((target[x] + quality.PRIOR * p) / (all_target + quality.PRIOR) / p)

    scores = {k: sum(map(ratio, g)) / len(g) if g else 0.0 for k, g in grams.items()}
    passed = {k: (c := counts_of(t or ""))[0] >= 20 and 100 * c[4] <= 30 * c[0] for k, t in truth.items()}
    held = sorted(scores[k] for k in good if fold(k) and passed[k])
    lost = math.floor(quality.LOST * len(held))
    assert math.isclose(model.threshold, math.floor(held[lost] / quality.STEP) * quality.STEP)
    for r in quality.judged(docs, model, carry=("doc_id",)).collect():
        k = r["row"]["doc_id"]
        assert math.isclose(r["quality"]["score"], scores[k], abs_tol=1e-9)
        assert r["quality"]["kept"] == (passed[k] and scores[k] >= model.threshold)


def test_quality_on_held_out_documents(spark):
    """Labels of a third fold, neither counted nor used for the threshold, and a
    share of other documents that doesn't hang on the size of the table."""
    shares = []
    for scale, bad in (("0.01", 0.25), ("0.1", 0.02)):
        docs, labels = (spark.read.parquet(f"/root/testdata/sf{scale}/{t}.parquet") for t in ("documents", "labels"))
        seen = labels.filter("NOT (quality = 1 AND crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2)")
        rows = quality.judged(docs, quality.fit(docs, seen), carry=("doc_id",)).select("row.doc_id", "quality.*").join(labels, "doc_id", "left").collect()
        good = [r["kept"] for r in rows if r["quality"] == 1 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and not r["base_failed"]]
        assert sum(good) >= 0.98 * len(good)
        poor = [r["kept"] for r in rows if r["quality"] == 0]
        assert sum(poor) <= bad * len(poor)
        other = [r["kept"] for r in rows if r["quality"] is None and not r["base_failed"]]
        shares.append(sum(other) / len(other))
    assert abs(shares[0] - shares[1]) < 0.03


def test_quality_edges(spark):
    docs, labels = docs_of(spark, ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.kept(docs, labels)
    assert out.columns == docs.columns
    assert quality.kept(docs.limit(0), labels).count() == 0
    assert quality.judged(docs, quality.fit(docs, labels)).count() == len(ODD)
    assert math.isclose(quality.ratios(np.zeros(4), np.ones(4)).sum(), 0, abs_tol=1e-9)


def test_quality_target_is_every_good_document(spark):
    n = 60_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality")).unionAll(docs.limit(9).select("doc_id", F.lit(1)))
    assert quality.counted(quality.trusted(docs, labels)).sum() == 3 * n


# -- records and rules that were told wrong


def test_halves_of_surrogate_pairs_and_unread_fields_go_through_spark(spark):
    records = [
        r'{"messages":[{"role":"us\udc00er","content":"a\ud800b"}]}',
        '{"messages":[{"role":"user","content":"a","tool_calls":[{"x":1}]}],"prompt":"p"}',
        '{"chosen":"c","prompt":"a","completion":"b"}',
        '{"history":[["a","b"],{"role":"user","content":"x","z":1}],"instruction":"i","output":{"deep":["o"]},"input":null}',
        r'{"x":{"\ud800":1}}',
        '{"messages":[["bare",{"t":1}],null,7]}',
        None,
    ]
    rows = spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")
    got = {r["conv_id"]: r for r in chat.format_records(rows).collect()}
    assert chat.parsed(got[0]["formatted"]) == [("us�er", "a�b")]
    assert got[0]["turns_sha256"] == hashlib.sha256("us�er\na�b\n".encode()).hexdigest()
    assert [json.loads(got[k]["unread"]) for k in range(7)] == [[], ["messages[].tool_calls[].x", "prompt"], ["chosen"], ["history[].z"], ["x.�"], [], []]
    assert all(json.loads(r["unread"]) == [] for r in chat.format_records(chat.conversations(spark.read.parquet(f"{SF}/conversations.parquet"))).collect())


def test_url_rules_with_flags_or_sets_of_sets_are_refused():
    for regex in ("(?i)-Xfoo-", "(?i:-foo-)", "-(?-i:foo)-", "-foo-[a&&[b]]", "-foo-[a[b]]", r"-foo-\p{L}", "-foo-("):
        with pytest.raises(ValueError):
            urlfilter.PatternRule("block", regex, ("foo",))


def test_tokens_of_random_rules_hold_in_what_java_matches(spark):
    """Whatever a random expression fits has the tokens that were read off it."""
    rng = np.random.default_rng(8)
    pieces = ["a", "b", "X", "ab", "-", "/", r"\.", "[ab]", "[-/]", "[^a-z0-9]", "[^b]", ".", "a?", "(a|b-)", "(-ab)+", "(b)*", r"\b", "^", "$", r"\z", "_", r"\d", "(-|/b)", "b{1,2}", "é"]
    rules = []
    while len(rules) < 120:
        regex = "".join(rng.choice(pieces, rng.integers(2, 7)))
        try:
            ways = urlfilter.tokens_of_ways(regex)
        except ValueError:
            continue
        if all(ways):
            rules.append((regex, ways))
    urls = ["".join(rng.choice(list("ab-/._1é") + ["ab", "-ab-"], rng.integers(1, 9))) for _ in range(1500)]
    rows = spark.createDataFrame([(u,) for u in sorted(set(urls))], "url string").select("url", *(F.col("url").rlike(r).alias(f"r{k}") for k, (r, _) in enumerate(rules))).collect()
    fits = 0
    for row in rows:
        tokens = set(re.split("[^a-z0-9]+", row["url"]))
        for k, (regex, ways) in enumerate(rules):
            if row[f"r{k}"]:
                fits += 1
                assert any(w <= tokens for w in ways), (regex, row["url"], ways)
    assert fits > 500
