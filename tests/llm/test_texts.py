"""Secrets, encoding, pages, quality and language."""

import base64
import gzip
import hashlib
import json
import random
import struct
import time
import tracemalloc
import urllib.parse
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablekeep.llm import bpe, langid, quality, secrets, wrappers
from tests.llm.helpers import documents, odd_texts, sentence

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_layers():
    secret = 'password = "hunter2abcd"'
    quoted, packed = urllib.parse.quote(secret), base64.b64encode(gzip.compress(secret.encode())).decode()
    layers = {
        f"say {secret} now": "",
        f"see {quoted} now": "url",
        f"ünï {base64.b64encode(secret.encode()).decode()} x": "base64",
        packed: "compressed",
        urllib.parse.quote(base64.b64encode(("k " + quoted).encode()).decode(), safe=""): "base64/url",
        "".join(f"\\u{ord(c):04x}" for c in secret): "unicode",
        base64.b64encode(zlib.compress(base64.b64encode(secret.encode()))).decode(): "compressed/base64",
    }
    for text, layer in layers.items():
        found = secrets.scan(text)
        assert layer in [path for _, _, kind, path in found if kind == 0]
        assert all(0 <= s < e <= len(text) for s, e, _, _ in found)
    start, end, _, _ = secrets.scan(f"see {quoted} now")[0]
    assert urllib.parse.unquote(f"see {quoted} now"[start:end]) == secret[:-1]
    loop = "%2525252525"
    assert secrets.scan(loop) == []
    assert secrets.scan_layer("token=abc secret:abcdef AKIA" + "A" * 16 + " " + "0f" * 12) == [(10, 23, 0), (24, 44, 1), (45, 69, 2)]
    assert secrets.scan_layer("toKen: longenough")[0] == (0, 17, 0)
    assert not secrets.scan_layer("toKen: longenough")


def test_secrets_repeated():
    secret = "password=hunter2abcd"
    for token in (
        base64.b64encode(secret.encode()).decode(),
        base64.b64encode(gzip.compress(secret.encode())).decode(),
        urllib.parse.quote(secret),
        base64.b64encode(base64.b64encode(secret.encode())).decode(),
    ):
        text = f"a {token} b\nc {token} d\n{token}"
        spans = [text[s:e] for s, e, _, _ in secrets.scan(text)]
        assert len(spans) == 3 and len(set(spans)) == 1


def test_secrets_beside_spaces_and_over_lines():
    for text in ("password%3D hunter22abc", "api%5Fkey = abc123def", "\\u0070assword: hunter22", '{"p\\u0061ssword": "hunter22"}'):
        found = secrets.scan(text)
        assert any(k == 0 and text[s:e].rstrip('"}').endswith(text.split()[-1].strip('"}')) for s, e, k, _ in found)
    packed = base64.encodebytes(("x" * 45 + "\npassword=" + "hunter22abc" * 5).encode()).decode().rstrip()
    for text in (packed, packed.replace("\n", "\r\n  "), f"-----BEGIN-----\n{packed}\n-----END-----"):
        spans = [text[s:e] for s, e, k, _ in secrets.scan(text) if k == 0]
        assert any(span.split()[-1] == packed.rstrip("=").split()[-1] for span in spans)


def test_secrets_in_odd_bytes_and_members(monkeypatch):
    secret = b"password=hunter2abcd"
    for raw in (
        secret + b" \x00\xff",
        "\ufeff\u00a0\u200b".encode() + secret,
        gzip.compress(gzip.compress(secret)),
        gzip.compress(b"first") + gzip.compress(secret),
        gzip.compress(b"\x00" + secret),
        gzip.compress(b"first") + secret,
    ):
        found = secrets.scan(base64.b64encode(raw).decode())
        assert [k for _, _, k, _ in found] == [0]
    # a stream that unpacks to more than is held at once is scanned to its end, over the cuts too
    monkeypatch.setattr(secrets, "CHUNK", 1 << 20)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 12)
    for before in (1 << 20, (1 << 20) + (1 << 18) - 9, 5 << 20):
        packed = base64.b64encode(gzip.compress(b" " * before + secret + b" " * 3000)).decode()
        assert [(s, e, k) for s, e, k, _ in secrets.scan(f"x {packed}")] == [(2, 2 + len(packed.rstrip("=")), 0)]


def test_secrets_anywhere_in_a_run():
    """Nothing that stands in front of an encoded secret in the same run hides it."""
    secret = b'the password="hunter2abcdef" is'
    plain, packed = base64.b64encode(secret).decode(), base64.b64encode(gzip.compress(secret)).decode()
    for prefix in ("id-", "x/", "https://x.example/a/", "k_", "A", "AB", "ABC", "data:text/plain;base64,", "Bearer ", "a+b/"):
        for token in (plain, packed):
            text = f"see {prefix}{token} now"
            found = [(s, e) for s, e, k, _ in secrets.scan(text) if k == 0]
            assert found and all(4 <= s < e <= len(text) - 4 and e > 4 + len(prefix) for s, e in found)
            assert secrets.scan(f"a {prefix}b c-d") == []
    utf16 = base64.b64encode(secret.decode().encode("utf-16")).decode()
    for text in (utf16, f"q{utf16}", "ab\n" + "\n".join(plain[i : i + 3] for i in range(0, len(plain), 3)), plain[:2] + "\n" + plain[2:]):
        assert 0 in [k for _, _, k, _ in secrets.scan(text)]
    raw = gzip.compress(secret)
    for text in ("".join(f"%{b:02x}" for b in raw), "".join(f"\\x{b:02x}" for b in raw), "".join(f"\\u00{b:02x}" for b in zlib.compress(secret))):
        assert [k for _, _, k, _ in secrets.scan(f"say {text}, then")] == [0]


def test_secrets_in_random_nestings():
    """Whatever encodings a secret went through, in any order, it is found where its outermost form stands."""
    rng = random.Random(21)

    def wrapped(raw):
        width = rng.choice([4, 19, 64, 76])
        text = base64.b64encode(raw).decode()
        return rng.choice(["\n", "\r\n", "\n  "]).join(text[i : i + width] for i in range(0, len(text), width)).encode()

    steps = {
        "url": lambda raw: "".join(f"%{b:02X}" for b in raw).encode(),
        "some": lambda raw: urllib.parse.quote_from_bytes(raw).encode(),
        "unicode": lambda raw: "".join(f"\\u{b:04x}" for b in raw).encode(),
        "hex": lambda raw: "".join(f"\\x{b:02x}" for b in raw).encode(),
        "base64": base64.b64encode,
        "safe": lambda raw: base64.urlsafe_b64encode(raw).rstrip(b"="),
        "wrapped": wrapped,
    }
    packs = [gzip.compress, zlib.compress, lambda raw: gzip.compress(gzip.compress(raw)), lambda raw: raw.decode("latin-1").encode("utf-16-le")]
    for _ in range(250):
        raw = f"api_key = {''.join(rng.choices('abcdefgh12345678', k=rng.randrange(8, 30)))}".encode()
        names = []
        for _ in range(rng.randrange(1, 4)):
            name = rng.choice(list(steps))
            if rng.random() < 0.4 and name != "some":
                raw = rng.choice(packs)(raw)
                names.append("packed")
            raw = steps[name](raw)
            names.append(name)
        token = raw.decode()
        text = rng.choice(["", "see ", "x=(", "é,"]) + token + rng.choice(["", " now", ").", ","])
        found = [(s, e) for s, e, k, _ in secrets.scan(text) if k == 0]
        assert any(s < text.index(token) + len(token) and e > text.index(token) for s, e in found), (names, text[:200])


def test_large_texts_are_opened_around_their_escapes():
    text = "lorem ipsum, dolor\n" * 150_000 + "pass%77ord=hunter2abcd " + "one\n" * 40_000
    tracemalloc.start()
    found = secrets.scan(text)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert [text[s:e] for s, e, _, _ in found] == ["pass%77ord=hunter2abcd"]
    assert peak < 60 * len(text)


def test_find_and_redact(spark):
    texts = [*odd_texts(), "api_key: abcdef1234 and AKIA" + "B" * 16, "secret='" + "ab" * 20 + "'"]
    docs = documents(spark, texts)
    rows = {r.doc_id: r.found for r in secrets.find_secrets(docs).collect()}
    assert [len(rows[i]) for i in range(len(texts))] == [0] * len(odd_texts()) + [2, 2]
    masked = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert [masked[i] for i in range(len(odd_texts()))] == odd_texts()
    assert masked[len(texts) - 2] == "[secret] and [secret]"
    assert secrets.redact(docs).columns == docs.columns
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(4)
    alphabet = "abcdefghijklmnopqrstuvwxyzéüßİΣς'.,!1½́ \n\t日本<|>"
    texts = [*odd_texts(), "a<|endoftext|>B <|startoftext|>", "<|ENDOFTEXT|>", "İstanbul ΣΑΣ", "don't I'LL", "a" * 3000, "abcdefghij" * 300]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    found = {
        r.doc_id: r
        for r in bpe.encode(documents(spark, texts), PATH, ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    }
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        row = found[i]
        assert list(struct.unpack(f"<{row.n_tokens}I", row.ids)) == want
        assert row.decoded == library.decode(want, skip_special_tokens=False) == bpe.load(PATH).decode(bytes(row.ids))
        assert row.ids_sha256 == hashlib.sha256(row.ids).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(row.decoded.encode()).hexdigest()
    assert bpe.encode(documents(spark, []), PATH).count() == 0


def test_bpe_equals_the_library_on_every_code_point():
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    mine = bpe.load(PATH)
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(codes), 50_000):
        texts = [" ".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}2" for c in codes[i : i + 250]) for i in range(at, min(at + 50_000, len(codes)), 250)]
        for text, want, (ids, _) in zip(texts, library.encode_batch(texts, add_special_tokens=False), mine.encode_batch(texts), strict=True):
            assert np.frombuffer(ids, dtype="<u4").tolist() == want.ids, hex(ord(text[1]))


def test_pages(spark):
    story = "<h1>Title</h1><p>One&amp;two <b>bold</b>\n text<p>Second&nbsp;part<br>line<ul><li>x<li>y</ul>"
    noise = '<nav><a>menu</a></nav><div class="cookie-notice">eat</div><script>var a="<p>no</p>";</script>'
    tail = '<form><p>mail</p></form><aside>side</aside><section id="comments"><p>nice</p></section>'
    pages = [
        (1, "http://a.example/1", f"<html><body>{noise}<article>{story}{tail}</article><footer>f</footer></body></html>"),
        (2, "http://a.example/2", f"<html><body>{noise}<article><h1>T</h1><p>Z</p></article><footer>f</footer></body></html>"),
        (3, "http://b.example/1", f'<body><div class="menu">m</div><div id="content"><p>Hello <i>w</i>orld<p>two{tail}</div></body>'),
        (4, "http://b.example/2", '<body><div id="content"><p>A</p></div></body>'),
        (5, None, None),
        (6, "odd", ""),
        (7, "http://c.example", "plain & text < 3"),
        (8, "http://d.example", "<p>" * 3000 + "deep"),
        (1, "http://a.example/1", "<article>again</article>"),
    ]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("host", F.lit(1))
    rows = [(r.page_id, r.text) for r in wrappers.extract(frame).collect()]
    first = "Title\nOne&two bold text\nSecond part\nline\nx\ny"
    want = [(1, first), (2, "T\nZ"), (3, "Hello world\ntwo"), (4, "A"), (5, ""), (6, ""), (7, "plain & text < 3"), (8, "deep"), (1, "again")]
    assert sorted(rows) == sorted(want)
    found = {r.host: r for r in wrappers.infer_wrappers(frame).collect()}
    assert found["a.example"].element == "article" and found["a.example"].pages == 3
    assert wrappers.extract(frame.limit(0)).count() == 0


def test_wrapper_alignment():
    a = wrappers.stream("<ul><li>1</li><li>2</li><li>3</li></ul><p>x</p>")
    b = wrappers.stream("<ul><li>1</li></ul><h2>t</h2><p>x</p>")
    merged = wrappers.infer([a, b])
    assert ["+", ["<li>", "#", "</li>"]] in merged
    assert ["?", ["<h2>", "#", "</h2>"]] in merged


def accepts(wrapper, nodes):
    """Whether a wrapper, tried in every way, matches a row of tokens."""
    ends = {0}
    for node in wrapper:
        ends = _after(node, nodes, ends)
    return len(nodes) in ends


def _after(node, nodes, starts):
    if not isinstance(node, list):
        return {i + 1 for i in starts if i < len(nodes) and nodes[i] == node}
    kind, body = node
    found, fresh = set(starts) if kind == "?" else set(), set(starts)
    while fresh:
        for inner in body:
            fresh = _after(inner, nodes, fresh)
        fresh -= found
        found |= fresh
        if kind == "?":
            break
    return found


def _unfolded(page):
    out = []
    for kind, name, signature, text in wrappers.tokens(page):
        if kind != "text":
            out.append({"open": f"<{signature}>", "close": f"</{name}>", "void": f"<{signature}/>"}[kind])
        elif text.strip() and out[-1:] != ["#"]:
            out.append("#")
    return out


def test_wrappers_match_their_pages():
    """Streams say what their pages say, and the wrapper of two pages matches both, tried naively."""
    rng = random.Random(14)
    parts = ["<p>x</p>", "<h2>t</h2>", "<br>", "<ul><li>a</li><li>b</li></ul>", "<ul><li>a</li></ul>", "<div class=s><h3>h</h3><p>x</p><p>y</p></div>", "text"]
    for _ in range(150):
        pages = ["<body>" + "".join(rng.choices(parts, k=rng.randrange(12))) + "</body>" for _ in range(rng.randrange(1, 4))]
        streams = [wrappers.stream(p) for p in pages]
        assert all(accepts(s, _unfolded(p)) for s, p in zip(streams, pages, strict=True))
        merged = wrappers.align(streams[0], streams[-1])
        assert accepts(merged, _unfolded(pages[0]))


def test_long_groups_fold():
    section = "<section>" + "".join(f"<h{i}>t</h{i}><em>e</em>" for i in range(1, 7)) + "<hr></section>"
    streams = {json.dumps(wrappers.stream(f"<body><h1>t</h1>{section * n}<p>end</p></body>")) for n in range(2, 30)}
    assert len(streams) == 1


def test_long_pages_are_aligned_in_seconds(monkeypatch):
    rng = random.Random(15)
    tags = ["p", "h2", "h3", "blockquote", "pre", "figure", "table", "section", "div"]

    def page(n):
        return "<body>" + "".join(f"<{t} id=x{rng.randrange(40)}>words and words</{t}>" for t in rng.choices(tags, k=n)) + "</body>"

    one, other = page(20_000), page(20_000)
    assert len(one) > 600_000
    start = time.monotonic()
    wrapper = wrappers.infer([wrappers.stream(one), wrappers.stream(other)])
    assert time.monotonic() - start < 60 and wrapper
    monkeypatch.setattr(wrappers, "SMALL", 4)
    for _ in range(200):
        a, b = (rng.choices("abcdefgh", k=rng.randrange(15)) for _ in range(2))
        pairs = wrappers.matches(a, b)
        assert all(a[i] == b[k] for i, k in pairs)
        assert all(i < j and k < m for (i, k), (j, m) in zip(pairs, pairs[1:], strict=False))
        if a == b:
            assert len(pairs) == len(a)


def test_hosts_of_many_streams_and_columns_of_any_name(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN", 3)
    rng = random.Random(16)
    kinds = ["<h2>t</h2>", "<p>x</p>", "<pre>c</pre>", "<table><tr><td>1</td></tr></table>"]
    rows = [(i, "http://a.example/" + str(i), f"<nav>m</nav><main>{''.join(rng.sample(kinds, rng.randrange(1, 5)))}</main>", "x") for i in range(40)]
    frame = spark.createDataFrame(rows, "page_id int, url string, html string, element string")
    frame = frame.withColumn("page", F.lit(1)).withColumn("c0", F.lit(2)).withColumn("stream", F.lit("s")).withColumn("a.b", F.lit(3))
    out = wrappers.extract(frame)
    assert out.columns == ["page_id", "url", "element", "page", "c0", "stream", "a.b", "text"]
    found = out.collect()
    assert len(found) == 40 and all("m" not in r.text.split("\n") and r.element == "x" and r["a.b"] == 3 for r in found)
    assert [(r.element, r.pages) for r in wrappers.infer_wrappers(frame).collect()] == [("main", 40)]


def test_quality(spark):
    rng = random.Random(6)
    texts = [sentence(rng, 60) if i % 3 else " ".join(f"{w}###" for w in sentence(rng, 60).split()) for i in range(300)]
    docs = documents(spark, [*texts, *odd_texts()])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels, sample=150)
    rows = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((rows[i] >= 0.5) == (i % 3 > 0) for i in held) > 0.95 * len(held)
    assert all(0 <= s <= 1 for s in rows.values()) and len(rows) == 309
    assert rows[300] == rows[301]
    empty = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, empty).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_language(spark):
    rng = random.Random(7)
    words = {"aa": "the of and wood stone river".split(), "bb": "der und nicht über weiß straße".split(), "cc": "que está niño señor pero".split()}
    langs = [rng.choice([*words, None]) for _ in range(240)]
    texts = [" ".join(rng.choices(words[lang or "aa"], k=25)) for lang in langs]
    docs = documents(spark, [*texts, *odd_texts(), "12 34 !!"], lang=[*langs, *["aa"] * 10])
    model = langid.fit(docs.filter("doc_id < 240"), sample=30)
    rows = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    held = [i for i in range(240) if langs[i] and zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(rows[i].nearest == langs[i] for i in held) > 0.95 * len(held)
    assert [rows[i].nearest for i in (240, 241, 242, 249)] == ["und"] * 4
    assert all(0 <= r.score <= 1 for r in rows.values()) and rows[246].rejected
    none = langid.fit(docs.limit(0))
    assert {r.nearest for r in langid.identify(docs, none).collect()} == {"und"}
