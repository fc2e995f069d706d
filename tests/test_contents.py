"""Charsets and deadlines."""

import os
import time

import pytest

from sextant.functions import charsets
from sextant.operators import deadlines, extract

TEXTS = [
    ("Съешь же ещё этих мягких французских булок, да выпей чаю.", ["cp1251", "koi8_r", "cp866", "iso8859_5", "utf_16_le", "utf_8"]),
    ("Zażółć gęślą jaźń. Pchnąć w tę łódź jeża lub ośm skrzyń fig", ["cp1250", "iso8859_2", "utf_16_be"]),
    ("Příliš žluťoučký kůň úpěl ďábelské ódy.", ["cp1250", "iso8859_2"]),
    ("Árvíztűrő tükörfúrógép és jó foxim húszwattos lámpánál", ["cp1250", "iso8859_2"]),
    ("Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich", ["cp1252", "cp1250", "utf_16_le"]),
    ("Portez ce vieux whisky au juge blond qui fume, dès Noël où un zéphyr haï me vêt de glaçons", ["cp1252", "utf_8"]),
    ("いろはにほへと ちりぬるを。日本語の文章を書くときは、漢字と仮名を使います。", ["cp932", "euc_jp", "utf_16_le", "utf_16_be"]),
    ("视野无限广，窗外有蓝天。我们今天去学校学习中文，明天在家里休息。", ["gb18030", "utf_16_le"]),
    ("視野無限廣，窗外有藍天。我們今天去學校學習中文，明天在家裡休息。", ["big5"]),
    ("키스의 고유조건은 입술끼리 만나야 하고 특별한 기술은 필요치 않다.", ["euc_kr"]),
    ("Ξεσκεπάζω την ψυχοφθόρα βδελυγμία. Τάχιστη αλώπηξ βαφής", ["cp1253", "iso8859_7", "utf_16_le"]),
]


@pytest.mark.parametrize(("text", "charset"), [(t, c) for t, cs in TEXTS for c in cs])
def test_charsets(text, charset):
    assert charsets.decode(text.encode(charset)) == text
    long = (text + "\n") * 3000
    assert charsets.decode(long.encode(charset)) == long


def test_odd_bytes():
    assert charsets.guess(b"") == (None, 0.0) and charsets.decode(b"") is None
    assert charsets.guess(b"plain") == ("utf_8", 1.0)
    assert charsets.guess("é".encode() + b"\xc3") == ("utf_8", 1.0)  # cut within a character
    assert charsets.guess("é".encode("utf-8-sig"))[0] == "utf_8_sig" and charsets.guess("é".encode("utf-16"))[0] == "utf_16"
    for data in (bytes(range(256)), b"\xff" * 9, b"\x81\x8d\x8f\x90\x9d", os.urandom(5000)):
        assert charsets.decode(data) is not None
    assert extract.decode_text("Привет, мир и все".encode("koi8-r")) == "Привет, мир и все"


def local():
    """Readers that are pickled by value, as workers can't import the tests."""

    def endless(data):
        while True:
            pass

    def dying(data):
        os._exit(3)

    def broken(data):
        raise ValueError("no such thing")

    return endless, dying, broken


def test_deadline():
    start = time.monotonic()
    with deadlines.Runner([len, *local()], 0.4) as runner:
        found = [runner.call(k, b"abc") for k in (0, 1, 0, 2, 3, 0)]
    assert found == [(3, None), (None, "DeadlineExceeded: not done after 0.4 s"), (3, None), (None, "ReaderDied: exit code 3"), (None, "ValueError: no such thing"), (3, None)]
    assert time.monotonic() - start < 5


def test_files_that_hang_or_kill(spark):
    """Each costs its own row; the rest of the batch comes back."""
    rows = [(str(k), ("x/endless", "x/dying", "x/broken", "text/plain", None)[k % 5], b"text") for k in range(20)]
    files = spark.createDataFrame(rows, "path string, mime string, content binary").coalesce(1)
    readers = [(f"x/{f.__name__}", "Documents", lambda data, f=f: f(data), "1") for f in local()]
    found = {r.path: r for r in extract.extract(files, 0.3, readers).collect()}
    assert len(found) == 20 and all(found[str(k)].text == "text" and found[str(k)].error is None for k in range(3, 20, 5))
    assert [found[str(k)].error.split(":")[0] for k in range(3)] == ["DeadlineExceeded", "ReaderDied", "ValueError"] and found["4"].error is None


def test_many_calls_at_once():
    def reader(data):
        if data == b"hang":
            time.sleep(60)
        if data == b"die":
            os._exit(3)
        return data * 2

    with deadlines.Runner([reader], 0.3) as runner:
        found = list(runner.calls([(0, d) for d in (b"a", b"hang", b"b", b"die", b"die", b"c", None)]))
        assert found[0] == (b"aa", None) and found[2] == (b"bb", None) and found[5] == (b"cc", None)
        assert found[1][1].startswith("DeadlineExceeded") and found[3][1] == found[4][1] == "ReaderDied: exit code 3" and found[6][1].startswith("TypeError")
        assert list(runner.calls([])) == [] and runner.call(0, b"x") == (b"xx", None)


def test_few_charsets_are_looked_at_in_full(monkeypatch):
    seen, own = [], charsets._pair_cost
    monkeypatch.setattr(charsets, "_pair_cost", lambda text: seen.append(1) or own(text))
    text = "\u3042\u3046\u304f\u3067\u3044 \u4e00\u3064\u306e\u6587\u3002\n" * 50
    assert charsets.decode(text.encode("euc_jp")) == text and len(seen) < 6
