import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clonospark.llm import chat, decontam, html_text, licenses, packing, quality, sharding, shared, simhash, token_files, url_filter
from clonospark.llm.tokens import WordCodec, word_vocabulary

random.seed(11)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LEX = [f"w{i}" for i in range(400)]


def text(n):
    return " ".join(random.choice(LEX) for _ in range(n))


BASE = text(300)
TEXTS = [BASE, BASE, BASE + " tail", text(40), "", None, "one", "One", "a b", text(9000), "é ü " * 30, text(40), BASE.replace("w7 ", "w8 ", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s", 1), (None, "no id", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    # names that the operators use inside must not clash
    return df.withColumns({"fp": F.lit(1), "size": F.lit("x"), "part": F.lit(2), "rank": F.lit(None).cast("string"), "n_words": F.lit("y"), "_row": F.lit(3), "h": F.lit(4), "bucket": F.lit(5)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(pairs, near):
    root = {k: k for k, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in pairs:
        for b, y in pairs:
            if near(x, y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: find(k) for k in root}


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    fps = {r.doc_id: r.fp % 2**64 for r in got if r.doc_id is not None}
    assert all(fps[i] == fingerprint(TEXTS[i]) for i in range(len(TEXTS)))
    want = brute_components(sorted(fps.items()), lambda x, y: (x ^ y).bit_count() <= 2)
    assert {r.doc_id: r.component for r in got if r.doc_id is not None} == want
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("tile", [3, 2048])
def test_simhash_links_keep_components(spark, tile):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    fps = sorted({int(b) ^ (1 << int(i) if i < 63 else 0) ^ (1 << int(j) if j < 63 else 0) for b in base for i, j in rng.integers(0, 64, (6, 2))} | {0, -1, 1, 3, 7, 15, 31})
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), tile=tile)
    got = {x: x for x in fps} | {r.node: r.root for r in shared.components(edges).collect()}
    want = brute_components([(x, x % 2**64) for x in fps], lambda x, y: (x ^ y).bit_count() <= 2)
    assert got == want


def test_sharding(docs, empty):
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == docs.count() and sharding.shard(empty).count() == 0
    size = {i: len((t or "").encode()) + 1 for i, t in enumerate(TEXTS)}
    load = collections.Counter()
    for r in rows:
        load[r.shard] += r["size"]
        if r.doc_id is not None:
            assert r["size"] == size[r.doc_id] and r.text_crc32 == zlib.crc32((TEXTS[r.doc_id] or "").encode())
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids)
    for s in load:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
        assert abs(load[s] - sum(load.values()) / 4) <= max(size.values())


def test_codec_equals_library():
    codec = WordCodec.of(word_vocabulary())
    alphabet = [chr(i) for i in range(0x190)] + list("ΣσςЖж中") + ["<|endoftext|>", "\u0301", "  ", "\u2028"]
    for _ in range(3000):
        t = "".join(random.choice(alphabet) for _ in range(random.randint(0, 14)))
        assert codec.encode(t) == codec._whole(t), t


def test_token_files(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(word_vocabulary())
    token_files.write_tokens(docs, str(tmp_path / "t"))
    back = token_files.read_tokens(spark, str(tmp_path / "t"))
    rows = back.orderBy("start").collect()
    at = 0
    for r in rows:
        if r.doc_id is not None:
            assert r.ids == tok.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert r.start == at
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)
    sums = {r.start: r.ids_crc32 for r in token_files.id_checksums(back).collect()}
    assert all(sums[r.start] == zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) for r in rows)
    token_files.write_tokens(empty, str(tmp_path / "e"))
    assert token_files.read_tokens(spark, str(tmp_path / "e")).count() == 0


CHATS = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "<||x <| <|im_start|>"), (2, 0, None, None), (2, 1, "assistant", ""), (2, 2, "assistant", "é\n日本"), (2, 2, "assistant", "é\n日本"), (None, None, "a\nb", "<|endoftext|>"), (3, 5, "assistant", "z" * 3000), (3, 4, "user", "y")]


@pytest.mark.parametrize("most", [1, 1 << 16])
def test_chat(spark, most):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumns({"ids": F.lit(1), "piece": F.lit(2)})
    rows = chat.read_back(chat.format_chats(df, most_ids=most)).collect()
    groups = collections.defaultdict(list)
    for c, t, r, x in CHATS:
        groups[c].append((-1 if t is None else t, r or "", x or ""))
    assert len(rows) == len(groups)
    for r in rows:
        v = sorted(groups[r.conv_id])
        loss = "".join(x for _, role, x in v if role == "assistant")
        assert r.n_turns == len(v) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in v).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        marked = "".join(chat.START + chat.escape(a) + chat.SEP + chat.escape(x) + chat.END for _, a, x in v)
        assert r.formatted_chars == len(marked)
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_rows_without_conversation_stand_alone(spark):
    df = spark.createDataFrame([(None, 0, "user", f"t{i % 7}") for i in range(50)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    rows = chat.read_back(chat.format_chats(df)).collect()
    assert len(rows) == 51 and {r.n_turns for r in rows} == {1} and sum(r.formatted_chars for r in rows) == 50 * 38 + 32


def test_chat_codec_equals_library():
    codec = chat.Codec.of(chat.chat_vocabulary())
    alphabet = [chr(i) for i in range(0x260)] + list("'s't're ve   \n\n\t  ab<|") * 12 + list("ΣЖ中") + ["<|endoftext|>", "\u0301", "\u2028", " a", " Foo,", "\x1c"]
    for n in range(4000):
        t = "".join(random.choice(alphabet if n % 3 else alphabet[:0x250]) for _ in range(random.randint(0, 16)))
        assert codec.encode(t).tolist() == codec.tokenizer.encode(chat.escape(t), add_special_tokens=False).ids, t
        assert chat.unescape(codec.decode(codec.encode(t).tolist())) == t


def test_escape_is_reversible():
    for _ in range(2000):
        t = "".join(random.choice("<|>ab") for _ in range(8))
        assert chat.unescape(chat.escape(t)) == t and "<|a" not in chat.escape(t)


ITEMS = [(1, "In the year 1999 Anna walked, and then Anna ran 12 km to the old town before noon."), (2, BASE[:200]), (3, "tiny one"), (4, None), (5, "five short words stand here")]


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    more = [
        (50, "foo bar. In the year 2021 Peter walked, and then Peter ran 7 miles to the old town before noon. foo"),
        (51, "In the year 2021 Peter walked, and then Bob ran 7 miles to the old town before noon."),
        (52, "In the year 2021 nobody walked, and then"),
        (53, "xx five short words stand here yy"),
        (54, "tiny one"),
    ]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontam.matches(both, bench).collect()}
    item = BASE[:200].split()
    windows = {tuple(item[k : k + 8]): k for k in range(len(item) - 7)}
    holds = set()
    for i, t in enumerate(TEXTS):
        w = (t or "").split()
        shifts = collections.Counter(k - windows[tuple(w[k : k + 8])] for k in range(len(w) - 7) if tuple(w[k : k + 8]) in windows)
        holds |= {(i, 2)} if max(shifts.values(), default=0) >= min(6, len(windows) - 1) else set()
    assert {d for d, _ in holds} == {0, 1, 2, 12}
    assert got == holds | {(50, 1), (53, 5)}
    assert got == {(r.doc_id, r.item_id) for r in decontam.matches(both, bench, most=5).collect()}
    assert decontam.matches(empty, bench).count() == 0 and decontam.matches(both, bench.limit(0)).count() == 0
    left = decontam.clean(both, bench)
    assert left.count() == both.count() - sum(d in {x for x, _ in got} for d in [*range(len(TEXTS)), 3, *(x for x, _ in more)])


WORDY = "Tom has 3 apples. Tom buys 4 more apples. Tom eats 2 apples. How many apples does Tom have?"


def test_decontamination_of_names_that_open_sentences(spark):
    bench = spark.createDataFrame([(1, WORDY)], "item_id long, text string")
    texts = [
        WORDY,
        "x. Anna has 5 apples. Anna buys 6 more apples. Anna eats 7 apples. How many apples does Anna have? y",
        'x\nAnna has 5 apples.\nAnna buys 6 more apples. "Anna eats 7 apples. How many apples does\nAnna have? y',
        "x. Anna has 5 apples. Bob buys 6 more apples. Anna eats 7 apples. How many apples does Anna have? y",
        "x. Anna has 5 apples. Anna sells 6 more pears. Anna eats 7 apples. y",
    ]
    held = decontam.matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id, r.n_windows) for r in held} == {(0, 1, 12), (1, 1, 12), (2, 1, 12)}


def test_decontamination_of_dense_and_repeated_items(spark):
    items = [(1, "Compute 12 times 7 plus 9 minus 4."), (2, "Tom 3 Bob 4 Eve 5 km Ann 6 Joe 7 and Sam 8 Lee 9 Kim"), (3, "alpha beta gamma delta epsilon zeta eta theta iota"), (3, "alpha beta gamma delta epsilon zeta eta theta iota")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = ["z: Compute 12 times 7 plus 9 minus 4. z", "z: Compute 12 times 7 plus 9 minus 5. z", f"q {items[1][1]} q", "q Tom 3 Bob 4 Eve 5 km Ann 6 Joe 8 and Sam 9 Max 1 Kim q", f"so {items[2][1]} on"]
    held = decontam.matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench)
    assert {(r.doc_id, r.item_id) for r in held.collect()} == {(0, 1), (2, 2), (4, 3)}
    assert held.count() == decontam.matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench, most=3).count()


def test_decontamination_of_values_spelt_otherwise(spark):
    items = [(1, "what is 12 plus 13"), (2, "12 + 15 = 27, 30 + 40 = 70, 1 + 2 = 3"), (3, "name the capital city"), (4, "Tom Brown has 3 boxes. Tom buys 4 more boxes of red pens. How many boxes does Tom Brown have now?"), (5, "Tom has three boxes with 12 red pens in each of them and gives 2 km away")]
    texts = {
        1: "what is 12 plus 13",
        2: "x 12 + 15 = 27, 30 + 40 = 70, 1 + 2 = 3 y",
        3: "Please, name the capital city now",
        4: "Mary has 5 boxes. Mary buys 7 more boxes of red pens. How many boxes does Mary have now?",
        5: "Problem: Jo Ann Lee has 5 boxes. Jo buys 7 more boxes of red pens. How many boxes does Jo Ann Lee have now?",
        6: "Ann has 5 boxes with 7 red pens in each of them and gives twenty miles away",
        7: "Ann has twenty-five boxes with 7 red pens in each of them and gives 2 km away",
        8: "Mary sells 5 boxes. Mary buys 7 boxes of red pens. Not many boxes.",
        9: "What Is " * 20_000 + "name the capital town",
    }
    halves = ["Mary has 5 boxes. Mary buys 7 more boxes", "of red pens. How many boxes does Mary have now?"]
    rows = [*texts.items(), *((None, x) for x in halves), *((70, x) for x in halves), (None, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_id": F.lit("a"), "_h": F.lit("b"), "item_id": F.lit("c")})
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (200_000, 3):
        held = decontam.matches(df, bench, most=most).collect()
        assert {(r.doc_id, r.item_id) for r in held} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 5), (7, 5), (None, 4)}
        left = decontam.clean(df, bench, most=most)
        assert left.columns == df.columns and sorted((r.doc_id or 0, r.text, r._id) for r in left.collect()) == sorted((i or 0, x, "a") for i, x in rows if i in (8, 9) or x in halves)


def test_decontamination_recall_on_other_values(spark):
    rng = random.Random(3)
    names, verbs, things = "Tom Anna Peter Maria Ahmed Chen Olga Ravi".split(), "buys sells finds counts packs paints".split(), "boxes pens cups books stones apples".split()

    def problem(seed, a, b, number):
        r = random.Random(seed)
        v, x, y = [r.choice(verbs) for _ in range(3)], r.choice(things), r.choice(things)
        return f"{a} {v[0]} {number()} {x} at the market on a {r.choice(['cold', 'warm', 'dark'])} day. {b} {v[1]} {number()} {y} from {a}. Then {a} {v[2]} {number()} more {x}. How many {x} does {a} have now, and how many {y} does {b} have?"

    plain = lambda: rng.randint(2, 900)
    other = lambda: rng.choice([str(rng.randint(2, 900)), f"{rng.randint(1, 9)},{rng.randint(100, 999)}", rng.choice(decontam.SMALL), f"{rng.choice(decontam.TENS)}-{rng.choice(decontam.SMALL[1:10])}"])
    items = [(i, problem(i, *rng.sample(names, 2), plain)) for i in range(60)]
    texts = [(i, f"{text(30)}. {problem(i, *rng.choice([rng.sample(names, 2), ['Jo Ann Lee', 'Max']]), other)} {text(20)}") for i in range(60)]
    clean = [(1000 + i, f"{text(30)}. {problem(5000 + i, *rng.sample(names, 2), other)} {text(20)}".replace("at the market on a", "in town one").replace("How many", "Say which").replace("Then", "later").replace("from", "without")) for i in range(60)]
    held = decontam.matches(spark.createDataFrame(texts + clean, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {r.doc_id for r in held if r.doc_id == r.item_id}
    assert len(found) >= 54
    assert not any(r.doc_id >= 1000 for r in held)


def test_quality(docs, empty):
    for r in quality.judge(docs).collect():
        if r.doc_id is None:
            continue
        t = TEXTS[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = collections.defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        covered = {p + o for v in at.values() if len(v) > 1 for p in v for o in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality.judge(empty).count() == 0
    names = ["n_words", "_words", "_lines", "_solid", "_grams", "_sorted", "_places", "kept", "base_failed", "word_chars", "in0", "n_lines"]
    clash = docs.select("doc_id", "text").withColumns({n: F.lit("mine") for n in names})
    got = quality.passing(clash).collect()
    assert quality.passing(clash).columns == clash.columns and len(got) == quality.judge(docs).where("kept").count()
    assert all(r[n] == "mine" for r in got for n in names) and quality.judge(clash).where("in0 <> 'mine' or _words <> 'mine'").count() == 0
    assert quality.judge(docs).where("kept").count() == sum(bool(r.kept) for r in quality.judge(docs).collect())


PAGE = "<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li>Home<li>News</ul></nav><div class=ad>buy {i}</div><div>site line</div><article><h1>H {i}</h1><p><b>one &amp; {i}<br>two<p>three\n  four<div class='comments'><p>bad</div></article><form>f</form><footer>&copy; x</footer></body></html>"
BARE = "<body><div><ul><li>Menu</ul></div><div>text of page {i}</div><div>always the same end</div></body>"


def test_html(spark):
    rows = [(i, f"http://a.org/{i}", PAGE.replace("{i}", str(i))) for i in range(8)] + [(100 + i, "https://b.org/", BARE.replace("{i}", str(i))) for i in range(6)]
    rows += [(200, None, None), (201, "x", ""), (202, "http://c/", "a < b & <p"), (0, "http://a.org/0", PAGE.replace("{i}", "0"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"_row": F.lit(1), "text": F.lit("clash"), "hash": F.lit(2)})
    got = html_text.extract(df).collect()
    assert len(got) == len(rows)
    at = {r.page_id: r.text for r in got}
    assert at[3] == "H 3 one & 3 two three four" and at[102] == "text of page 2" and at[200] == "" == at[201]
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(df.limit(0)).count() == 0


SITE = "<body><div class='x1'><span>Shop</span> the best of {h}</div><div>story {i} of {h}, told at length</div><div class='x2'><div>read on</div><div>all rights {h}</div></div></body>"


def test_html_templates_decide(spark):
    rows = [(100 * h + i, f"http://h{h}.org/{i}", SITE.replace("{i}", str(i)).replace("{h}", f"h{h}")) for h in range(3) for i in range(9)]
    rows += [(900 + i, "http://few.org/", SITE.replace("{i}", str(i)).replace("{h}", "few")) for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    # brute force: of each host, block texts on five or more of its pages go
    want = {}
    for p, u, page in rows:
        parts = re.findall(r">([^<>]+)(?=<)", page.replace("<span>", "").replace("</span>", ""))
        own = [[re.findall(r">([^<>]+)(?=<)", y.replace("<span>", "").replace("</span>", "")) for _, v, y in rows if v.split("/")[2] == u.split("/")[2]]][0]
        want[p] = " ".join(x for x in parts if sum(x in o for o in own) < 5)
    on, off = ({r.page_id: r.text for r in html_text.extract(df, many=m).collect()} for m in (5, 10**9))
    assert on == want and all(on[p] != off[p] for p in on if p < 900) and on[901] == off[901] != ""


def test_html_keeps_all_articles_and_plain_marks():
    def text_of(page):
        root = html_text.parse(page)
        html_text.digest(root)
        return html_text.main_text(root)

    assert text_of("<nav>n</nav><article><p>one</p></article><article><p>two</p></article><article class=comment>c</article>") == "one two"
    assert text_of("<main><header class='entry-header'><h1>T</h1></header><div class='side-note'>kept</div><div class='comments'>gone</div><section id='related-work'>r</section></main>") == "T kept r"


@pytest.mark.parametrize("unit", ["<script", "<a '", "<div>", "<ul><li>", "</p>", "<div></ul>", "<!--", "<p><b>x", "<td></li>", '<a b="', "&amp;<"])
def test_html_long_hostile_pages_take_seconds(unit):
    import time

    start = time.time()
    root = html_text.parse(unit * (1_500_000 // len(unit)))
    html_text.digest(root)
    html_text.main_text(root)
    assert time.time() - start < 20


def test_html_random_markup_never_fails():
    bits = ["<p>", "</p>", "<div class='ad'>", "</div>", "<article>", "</article>", "<b>", "<!-- c -->", "<script>x<y</script>", "&amp;", "&#x41;", " w ", "<li>", "</ul>", "<td>", "<br/>", "<", ">", '<a href="a>b">', "<img src='", "<title>", "</"]
    for _ in range(2000):
        root = html_text.parse("".join(random.choice(bits) for _ in range(12)))
        html_text.digest(root)
        html_text.main_text(root)


URLS = ["http://www.example.com/en/712", "HTTP://EXAMPLE.com/en/8?x#y", "https://a.net/de/1", "https://example.net/de/8", "https://example.net/de/7", "ftp://x.org/es/", "http://x.org/esx", "none", None, "", "://", "http://Sub.spam-farm.example.org", "http://notspam-farm.example.org", "http://spam-farm.example.org?q", "http://com/en/", "http://a..com/en/x", "http://xcom/en/", "a://b://com/en/"]


def test_urls(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumns({"host": F.lit(1), "key": F.lit("k")})
    for r in url_filter.judge(df).collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", URLS[r.page_id] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), len(h), v, h + p) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        under = any(host == b or host.endswith("." + b) for b in url_filter.BLOCKED_HOSTS)
        best = max(fit) if fit else (0, 0, "block" if under else "allow", None)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[3], best[2]), URLS[r.page_id]
    assert url_filter.judge(df.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = [f"k{i}" for i in range(0, 3000, 17)] + ["absent"]
    c = url_filter.Cascade.build(listed, universe)
    got = {r.key for r in universe.where(c.has(F.col("key"))).collect()}
    assert got == set(listed) - {"absent"} and len(c.levels) > 1


def test_licenses(spark, docs, empty):
    mit = licenses.TEXTS[0][1]
    rows = [(1, "Copyright (c) 2020 A. Person\n\n" + mit.replace("\n", " ").upper()), (2, text(50) + "\nReleased under the MIT Licence."), (3, "SPDX-License-Identifier: Apache-2.0\nx"), (4, "the mit licence is a license that we name"), (5, "This work is licensed under the GNU General Public License, version 3."), (6, None), (7, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"scope": F.lit("s"), "license": F.lit(1)})
    got = {(r.doc_id, r.license, r.scope) for r in licenses.scan(df).collect()}
    assert got == {(1, "MIT", "document"), (2, "MIT", "line"), (3, "Apache-2.0", "line"), (5, "GPL-3.0", "document"), (7, "CC-BY-NC-4.0", "line")}
    assert licenses.scan(docs).count() == 0 and licenses.scan(empty).count() == 0


def test_whole_licenses_inside_longer_texts(spark):
    code = "def f(x):\n    return x\n\nmain()"
    wrap = lambda t: "\n\n".join("\n".join(" ".join(p.split()[i : i + 9]) for i in range(0, len(p.split()), 9)) for p in t.split("\n\n"))
    rows, want = [], {}
    for i, (name, body) in enumerate(licenses.TEXTS):
        rows += [(10 * i, f"{code}\n\nCopyright 2021 The Authors\n\n{wrap(body)}\n\n{code}"), (10 * i + 1, wrap(body).replace("\n\n", "\n\nCopyright (c) 2020 Some One\n\n", 1))]
        want |= {10 * i: name, 10 * i + 1: name}
        if "\n\n" in body:
            rows.append((10 * i + 2, f"{code}\n\n{body.rsplit(chr(10) * 2, 1)[0]}\n\nother words\n\n{body.rsplit(chr(10) * 2, 1)[1]}"))
    rows += [(900, "Released under the MIT license.\nx\nReleased under the MIT license."), (901, f"{licenses.TEXTS[0][1]}\n\n{code}\n\n{licenses.TEXTS[0][1]}")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.license for r in got if r.doc_id < 900} == want
    assert {(r.doc_id, r.license, r.scope, r.n_found) for r in got if r.doc_id >= 900} == {(900, "MIT", "line", 2), (901, "MIT", "paragraph", 2)}


def test_licenses_of_a_callers_table(spark):
    own = "Do as you like with these words.\n\nBut keep this note."
    table = licenses.known(spark, [("Own-1.0", own)], [("None", ["none at all"])])
    rows = [(1, own.upper()), (2, "x\n\nDo as you like with these words."), (3, "DO as you like, with these words!\n\nBut keep this note"), (4, None)]
    got = {(r.doc_id, r.license, r.scope) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()}
    assert got == {(1, "Own-1.0", "document"), (3, "Own-1.0", "document")}


def test_best_bounds_equals_brute_force():
    from itertools import combinations

    for _ in range(60):
        counts = {random.randint(1, 60): random.randint(1, 9) for _ in range(random.randint(1, 11))}
        k, ls = random.randint(1, 4), sorted(counts)
        waste = lambda bounds: sum(n * (min(b for b in bounds if b >= x) - x) for x, n in counts.items())  # noqa: B023, E731
        want = min(waste((*c, ls[-1])) for m in range(k) for c in combinations(ls[:-1], min(m, len(ls) - 1)))
        assert waste(packing.best_bounds(counts, k)) == want


def test_packing(docs, empty):
    rows = packing.pack(docs, budget=600, buckets=3).collect()
    assert len(rows) == docs.count() and packing.pack(empty).count() == 0
    batches = collections.defaultdict(list)
    for r in rows:
        assert r.padding == r.bucket_len - r.n_tokens >= 0
        batches[r.bucket, r.batch].append(r)
    for v in batches.values():
        assert sum(r.bucket_len for r in v) <= 600 or len(v) == 1
        assert sorted(r.slot for r in v) == list(range(len(v)))
    assert max(r.n_tokens for r in rows) > 600


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [(200 + i, "the " + text(60) + f" and {i}", "en", "s", 1) for i in range(20)]
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(clean, DOCS))
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = shared.cut(stage(spark, now, str(tmp_path)), "test")
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    out = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == {r.doc_id for r in now.collect()} and {x[0] for x in clean} <= out


def test_stages_keep_clashing_columns_and_empty_tables(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["_id", "_h", "none", "h", "bare", "key", "n", "id", "_rest", "_text", "n_words", "_words", "in0", "item_id", "component", "kept"]
    body = "the " + text(60)
    rows = [(1, body), (1, "and " + text(50)), (1, body), (None, "of " + text(40)), (7, body + " x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(f"mine {n}") for n in names})
    for some in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, str(tmp_path))
            assert out.columns == df.columns
            got = out.collect()
            assert all(r[n] == f"mine {n}" for r in got for n in names)
            if stage is corpus_pipeline.near_dedup and some is df:
                assert sorted((r.doc_id or 0, r.text) for r in got) == sorted({(i or 0, x) for i, x in rows[:4]})
            assert some is df or not got


def test_near_dedup_stage_keeps_the_least(spark, docs):
    import corpus_pipeline

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    want = brute_components([(i, fingerprint(t)) for i, t in enumerate(TEXTS)], lambda x, y: (x ^ y).bit_count() <= 2)
    rows = corpus_pipeline.near_dedup(spark, plain, "").collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(set(want.values()))
    assert sum(r.doc_id is None for r in rows) == 1


def test_near_dedup_stage_drops_edited_copies(spark):
    import corpus_pipeline

    line = text(12)
    bases = [text(n) for n in (60, 200, 900)] + [line + " " + text(20) for _ in range(30)] + [line, "one two", "one two three"]
    rows = [*bases]
    for b in bases[:3]:
        w = b.split()
        rows += [" ".join("edited" if i == k else x for i, x in enumerate(w)) for k in range(7, len(w), len(w) // 6)] + [" ".join(w[k:]) for k in (2, 5, 9, 14)] + [b + " " + text(len(w) // 5)]
    rows = random.sample(rows, len(rows))

    def similar(a, b):
        return len(a & b) * 5 >= 4 * len(a | b)

    runs = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, rows)]
    pairs = [len(a & b) / len(a | b) for i, a in enumerate(runs) for b in runs[:i] if a != b and similar(a, b)]
    assert min(pairs) < 0.85 and max(pairs) > 0.97
    want = brute_components(list(enumerate(runs)), similar)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(rows)], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == sorted(set(want.values()))


def test_character_references():
    root = html_text.parse("<p>&lt;b&gt; &eacute; &#233; &nbsp;x</p>")
    html_text.digest(root)
    assert html_text.blocks(root, frozenset(), False) == [" ".join(html.unescape("&lt;b&gt; &eacute; &#233; &nbsp;x").split())]
