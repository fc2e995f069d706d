"""OpenDocument by kind, disc images, shipped rules."""

import io
import tracemalloc
import zipfile

import pytest

from sextant.operators import discs, extract
from sextant.plans import packages
from sextant.rules import RULES


@pytest.mark.parametrize(
    ("kind", "text"),
    [("text", "abéc bé"), ("presentation", "a! a bé c a bé "), ("spreadsheet", "a bé bé "), ("graphics", "a bé bé ")],
)
def test_open_document(kind, text):
    types, props, found = extract.read_open_document(packages.open_document(kind, "T", ["a", "bé", "c"]))
    assert (found, props["nie:title"], props["nfo:pageCount"]) == (text, "T", "1")
    with zipfile.ZipFile(io.BytesIO(packages.open_document(kind, "T", ["a", "bé", "c"]))) as z, z.open("content.xml") as member:
        assert extract.open_document_text(member, kind, 2).startswith(text[:1])
    with pytest.raises(Exception, match="no element|not well-formed|mismatched"):
        extract.open_document_text(io.BytesIO(b"<a><b></a>"), kind)


def test_large_member_in_bounded_memory():
    """200 MB of content, of which the first MB is read."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/vnd.oasis.opendocument.text")
        z.writestr("meta.xml", "<m/>")
        with z.open("content.xml", "w") as member:
            member.write(b"<c>")
            for _ in range(200):
                member.write(b"<text:p>" + b"word " * 209_000 + b"</text:p>")
            member.write(b"</c>")
    tracemalloc.start()
    found = extract.read_open_document(out.getvalue())[2]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == extract.TEXT_BYTES and most < 20_000_000


def test_discs():
    ok = packages.disc("BOOT = cdrom:\\SLUS_1;1\r\n", "SLUS_1", False)
    assert discs.is_first_system(ok) and not discs.is_first_system(ok[: 18 * discs.FRAME]) and not discs.is_first_system(b"")
    assert discs.is_first_system(packages.disc("x\ncdrom:slus_1;1", "SLUS_1", False))
    assert not discs.is_first_system(packages.disc("BOOT = cdrom:\\OTHER;1", "SLUS_1", True))
    assert discs.is_first_system(packages.disc(None, "SLUS_1", True)) and not discs.is_first_system(packages.disc(None, "SLUS_1", False))
    for n in range(0, len(ok), 977):  # cut and damaged images raise nothing
        discs.is_first_system(ok[:n])
        discs.is_first_system(ok[:n] + b"\xff" * 3000 + ok[n + 3000 :])


def test_games(spark):
    ok = packages.disc("BOOT = cdrom:\\SLUS_1;1\r\n", "SLUS_1", False)
    other = b"\0" * discs.OTHER_AT + discs.OTHER + b"\0" * 9
    sheet = lambda *tracks: "\n".join(f'FILE "{f}" BINARY\n  TRACK {k:02d} {m}\n    INDEX 01 00:00:00' for k, (f, m) in enumerate(tracks, 1)) + "\n"
    sheets = [
        ("/g/a.cue", sheet(("/g/a.bin", "MODE2/2352"))), ("/g/b.cue", sheet(("/other/place/a.bin", "MODE1/2352"))), ("/g/c.cue", sheet(("a.bin", "AUDIO"))), ("/g/d.cue", sheet(("x.wav", "AUDIO"), ("t.bin", "MODE1/2048"))),
        ("/g/e.cue", sheet(("t.bin", "MODE1/2352"), ("t.bin", "MODE1/2352"))), ("/g/f.cue", "no sheet"), ("/g/g.cue", None), ("/g/h.cue", sheet(("absent.bin", "MODE2/2352"))), ("/g/i.cue", 'FILE "t.bin" BINARY\n TRACK 01 AUDIO\n TRACK 02 MODE1/2352\n'),
    ]
    found = discs.games(spark.createDataFrame(sheets, "path string, text string"), spark.createDataFrame([("/g/a.bin", ok), ("/g/t.bin", other), ("/g/n.bin", None)], "path string, content binary"))
    assert sorted(map(tuple, found.select("path", "image", "system").collect())) == [("/g/a.cue", "/g/a.bin", "psx"), ("/g/b.cue", "/g/a.bin", "psx"), ("/g/d.cue", "/g/t.bin", "tg"), ("/g/e.cue", "/g/t.bin", "tg"), ("/g/i.cue", "/g/t.bin", "tg")]


def test_games_move_no_contents(spark):
    """Contents of images are in no exchange and no broadcast."""
    sheets = spark.createDataFrame([("/g/a.cue", "")], "path string, text string")
    images = spark.range(9).selectExpr("concat('/g/', id) AS path", "binary('x') AS content")
    plan = discs.games(sheets, images)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.rindex("Join ") < plan.index("MapInArrow")


def test_rules():
    assert len(RULES) == 33 and [r[0] for r in RULES] == sorted(r[0] for r in RULES)
