"""XML as a stream of tags, against a parser that holds the whole document."""

import random
import xml.etree.ElementTree as ET

import pandas as pd
import pytest

from cellsieve.sources import xml_files, xml_tags


def local(e):
    return e.tag.rpartition("}")[2]


def brute_levels(root):
    """(record path, children) of repeated levels in document order."""
    out = []

    def go(e, path):
        tags = [local(c) for c in e]
        if len(tags) > 1 and len(set(tags)) == 1:
            out.append((f"{path}.{tags[0]}", len(tags)))
        for c in e:
            go(c, f"{path}.{local(c)}")

    go(root, local(root))
    return out or [(f"{local(root)}.{local(root[0]) if len(root) else 'record'}", len(root))]


FILLERS = ["<!-- <a> > -- -->".replace("-- -->", "-->"), "<![CDATA[<b> </c> ]> > ]]>", "<?p x > y?>", " > ", "&lt;", "\n", ""]


def random_xml(rng, depth=0, tag=None):
    tag = tag or rng.choice("abc")
    attributes = rng.choice(["", ' x="1>2"', " y='a\"b>'", ' z="a/"', " v = '\n'"])
    if depth > 4 or rng.random() < 0.2:
        return rng.choice([f"<{tag}{attributes}/>", f"<{tag}{attributes} />", f"<{tag}{attributes}>t{rng.choice(FILLERS)}</{tag} >"])
    same = rng.choice([None, "c"])
    inner = "".join(random_xml(rng, depth + 1, same) + rng.choice(FILLERS) for _ in range(rng.randrange(4)))
    return f"<{tag}{attributes}>{inner}</{tag}>"


def documents(seed, n):
    rng = random.Random(seed)
    head = ["", "<?xml version='1.0'?>\n", "<!DOCTYPE a [ <!ENTITY q 'z'> <!ELEMENT a ANY> ]>", "<!-- - > -->\n"]
    return [rng.choice(head) + random_xml(rng) + rng.choice(["", "\n", "<!-- end > -->"]) for _ in range(n)]


def test_walk_finds_the_levels_of_a_parser():
    for text in documents(1, 800):
        walk, found, root = xml_tags.Walk("d", 0), [], None
        for piece in xml_tags.pieces(text.encode()):
            opened, closed = walk.take(piece)
            root = root or opened
            if closed is not None and closed.repeats:
                found.append((closed.nth, f"{closed.path}.{closed.low}", closed.children))
        walk.end()
        want = brute_levels(ET.fromstring(text))
        assert [f[1:] for f in sorted(found)] == (want if found else []), text


@pytest.mark.parametrize("bad", ["<a><b></a>", "<a>", "<a></a></a>", "<a x='1></a>", "<a x=\"<\"/>", "<a><!-- </a>", "<a>< b/></a>", "<a"])
def test_malformed(bad):
    with pytest.raises(ValueError):
        walk = xml_tags.Walk("d", 0)
        for piece in xml_tags.pieces(bad.encode()):
            walk.take(piece)
        walk.end()


def test_splits_compose_to_the_whole():
    """A document cut after any of its pieces: every split gets the stack and state of the walk over all of it."""
    rng = random.Random(2)
    for text in documents(3, 300):
        found = list(xml_tags.pieces(text.encode()))
        cuts = sorted({0, *(rng.randrange(len(found)) for _ in range(3))})
        rows, want = [], {}
        walk = xml_tags.Walk("d", 0)
        for i, piece in enumerate(found):
            if i in cuts:
                want[i] = (walk.state, [e.name for e in walk.stack])
            walk.take(piece)
        for start, end in zip(cuts, [*cuts[1:], len(found)]):
            batch = xml_tags._rows([("d", start, p) for p in found[start:end]], xml_tags.pa.schema(
                [("file", xml_tags.pa.string()), ("start", xml_tags.pa.int64()), ("piece", xml_tags.pa.binary())]))
            rows += [b.to_pandas() for b in xml_tags._effects(iter([batch.slice(0, 2), batch.slice(2)]))]
        got = xml_tags._composed(pd.concat(rows))
        assert {r.start: (r.state, [o["name"] for o in r.opened]) for r in got.itertuples()} == want, text


@pytest.fixture
def small_splits(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "2000")
    yield
    for n, value in before.items():
        spark.conf.set(n, value)


def test_large_files_are_read_by_many_tasks(spark, tmp_path, small_splits):
    rows = "".join(f'<n:o id="{i}>"><k>{i}</k><!-- <o> > --><v><![CDATA[{i}<o>]]></v></n:o>\n' for i in range(400))
    long = "x>" * 3000  # one record over several splits
    text = (f"<?xml version='1.0'?><r xmlns:n='u'><tail><o><k>stray</k></o></tail><os>{rows}<n:o id='l'><k>{long}</k><v/></n:o>"
            f"<!-- {'<o><k>no</k></o>' * 500} --></os></r>")
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "a b.xml").write_text(text)
    (tmp_path / "big" / "c.xml").write_text("<r><os><o id='s'><k>small</k><v>1</v></o></os><z><o/></z></r>")
    path = str(tmp_path / "big")
    assert xml_tags._pieces_of(spark, [path]).select("file", "start").distinct().count() > 10
    want = sorted([(f"{i}>", str(i), f"{i}<o>") for i in range(400)] + [("l", long, ""), ("s", "small", "1")])
    for kept in (True, None):
        got = xml_files.scan_xml(spark, path, "r.os.o", exact=kept).select("@id", "k", "v")
        assert sorted(tuple(r) for r in got.collect()) == want
    big = xml_files.XmlFiles(spark, str(tmp_path / "big" / "a b.xml"))
    numbered = big.records(["os", "o"], list(big.paths)).collect()
    assert [r["record"].count("<o ") for r in numbered] == [1] * 401  # in the order of the file
    places = {r["file"].rpartition("/")[2]: r for r in xml_files.record_places(xml_files.XmlFiles(spark, path), "r.os.o").collect()}
    assert (places["a%20b.xml"]["records"], places["a%20b.xml"]["elsewhere"]) == (401, True)


def test_record_paths_of_files_equal_those_of_documents(spark, tmp_path, small_splits):
    (tmp_path / "docs").mkdir()
    texts = documents(5, 12) + ["<r>" + "<x><y/></x>" * 900 + "<z/></r>", "<r><s>" + "<x><y/><w/></x>" * 900 + "</s><t/></r>"]
    for i, text in enumerate(texts):
        (tmp_path / "docs" / f"{i}.xml").write_text(text)
    got = {int(r["path"].rpartition("/")[2][:-4]): (r["record_path"], r["n_children"])
           for r in xml_files.file_record_paths(spark, str(tmp_path / "docs")).collect()}
    assert got == {i: brute_levels(ET.fromstring(text))[0] for i, text in enumerate(texts)}


def test_cut_out_records_equal_those_of_a_parser(spark, tmp_path):
    """Line breaks, comments, instructions, CDATA and `>` in cells and attributes."""
    cells = ["a\nb", "a\r\nb<!-- <o> -->c", "<![CDATA[<o>&\n]]>", "x > y", "&lt;o&gt;", "<?p <o> ?>q", "<![CDATA[]]]]><![CDATA[>]]>", "é"]
    rows = "".join(f"<o\n a='{i}>\"'><k>{cell}</k></o><!-- <o/> -->" for i, cell in enumerate(cells))
    text = f"<r><os>{rows}</os><o><k>stray</k></o></r>"
    (tmp_path / "a.xml").write_bytes(text.encode())
    want = sorted((o.attrib["a"], (o[0].text or "").strip()) for o in ET.fromstring(text.encode()).find("os"))
    got = xml_files.scan_xml(spark, str(tmp_path / "a.xml")).select("@a", "k")
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("seed", range(5))
def test_pieces_at_once_equal_one_by_one(seed):
    """Whole batches of tags are counted at once, beside the loop that steps from piece to piece."""
    rng = random.Random(seed)
    kinds = [b"x</a", b"<b", b"\n <b k='1'", b"<c/", b"text", b"</b", b"", b"\xe9</a", b"<a"]
    found = [rng.choice(kinds) for _ in range(rng.randint(1, 60))]
    ways = [[0, xml_tags.NORMAL, 0, [(b"r", 1), (b"s", 2)][:seed]] for _ in range(2)]
    ways = [[*way[:3], list(way[3])] for way in ways]
    tags = xml_tags._only_tags(xml_tags.pa.array(found, xml_tags.pa.binary()))
    xml_tags._go_by_tags(ways[0], tags, 5)
    xml_tags._go(ways[1], found, 5)
    assert ways[0] == ways[1]
    assert xml_tags._only_tags(xml_tags.pa.array([*found, b"<!-- "], xml_tags.pa.binary())) is None


def test_pieces_carry_no_paths(spark, tmp_path):
    """A path beside every piece took most of the time to hand pieces to Python."""
    (tmp_path / "a.xml").write_text("<a><b>1</b></a>")
    kinds = dict(xml_tags._pieces_of(spark, [str(tmp_path / "a.xml")]).dtypes)
    assert kinds["file"] == "bigint"
