from pyspark.sql import functions as F

from newsloom.llm import main_content, repeated_lines

NAV = "<nav><ul><li><a href='/a'>Markets</a></li><li>Cookies are used on this site. You can object.</li></ul></nav>"
FOOT = "<footer><p>All rights are reserved by Example Press.</p><p>Teaser about number {0} that is new</p></footer>"
PROSE = "Sentence {0} tells of firm {0} and its plans for the coming year. It hopes to grow by {0} percent."


def page(i, extra=""):
    return (
        f"<html><head><title>t</title><script>if (1<2) {{}}</script></head><body>{NAV}<main><article><h1>Title {i}</h1><p class=by>By Ann Author</p>"
        f"<p>{PROSE.format(chr(97 + i) * 3)}<p>{PROSE.format(chr(97 + i) * 4)}<div class=promo><a href='/r/{i}'>Read more: story {i}</a></div>{extra}"
        f"<p>This is no advice &amp; no offer.</p></article></main>{FOOT.format(chr(97 + i))}</body></html>"
    )


def body(i):
    return "\n".join([
        "Markets", "By Ann Author", PROSE.format(chr(97 + i) * 3), f"Read more: story {i}", PROSE.format(chr(97 + i) * 4), "This is no advice & no offer.", "",
        "All rights are reserved by Example Press.", f"Teaser about number {chr(97 + i)} that is new",
    ])


def test_outside_lines_and_main_text(spark):
    rows = [(str(i), "https://www.s.example/x", "s", page(i), body(i), "x") for i in range(8)]
    rows += rows[:2] + [("n", None, None, None, "x", "x"), ("e", None, None, "", "", "x"), ("b", None, None, "<p>only text. Here it is, all of it.", None, "x")]
    df = spark.createDataFrame(rows, "id string, url string, source string, html string, body string, row string")
    got = sorted((r["id"], r["line_no"]) for r in main_content.outside_lines(df).collect())
    assert got == [(str(i), n) for i in range(8) for n in (0, 3, 7, 8)]
    text = {r["id"]: r["main_text"] for r in main_content.main_text(df).collect()}
    assert "Markets" not in text["3"] and "Read more" not in text["3"] and "reserved" not in text["3"]
    assert "By Ann Author" in text["3"] and "no advice & no offer" in text["3"] and PROSE.format("dddd") in text["3"]
    assert text["b"].startswith("only text") and text["e"] == "" and "n" not in text
    assert main_content.outside_lines(df.limit(0)).count() == 0


def test_copies_of_an_article_are_no_template(spark):
    """Six copies under other ids of the host, two with another headline or an edit, do not make its paragraphs template."""
    rows = [(str(i), "https://s.example/x", "s", page(i), body(i)) for i in range(8)]
    html, text = page(9), body(9)
    edited = [html.replace("Title 9", "UPDATE Title 9"), html.replace("its plans", "new plans", 1)]
    rows += [(f"c{n}", "https://s.example/c", "s", h.replace("Teaser about number j", f"Teaser of {chr(97 + n) * 3}"), text) for n, h in enumerate([html] * 6 + edited)]
    df = spark.createDataFrame(rows, "id string, url string, source string, html string, body string")
    got = {}
    for r in main_content.outside_lines(df).collect():
        got.setdefault(r["id"], set()).add(r["line_no"])
    assert all(got[str(i)] == {0, 3, 7, 8} for i in range(8)) and all(got[f"c{n}"] == {0, 3, 7} for n in range(8))
    assert all(PROSE.format("jjjj") in r["main_text"] and "reserved" not in r["main_text"] for r in main_content.main_text(df).where("id like 'c%'").collect())


def test_a_share_of_the_host_is_required(spark):
    """A paragraph quoted in six articles of a large host is no template."""
    quoted = "<p>The notice of the regulator was quoted in full.</p>"
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = [(str(i), f"<h1>{word(i)}</h1><p>The story of {word(i)} is told here at its full length and with care.</p>" + (quoted if i < 6 else "")) for i in range(1500)]
    pages = main_content.parsed_pages(spark.createDataFrame([(a, "https://s.example", "s", h, "") for a, h in rows], "id string, url string, source string, html string, body string"))
    assert main_content.templates(pages).count() == 0 and main_content.templates(pages, share=0.0).count() == 1


def test_template_in_a_scattered_body_is_deleted(spark):
    """Where the body is the whole page, cookie notices and footers go; notices at the article's ends stay."""
    rows = []
    for i in range(8):
        a = chr(97 + i) * 3
        lines = ["Cookies are used on this site.", "By Ann Author", f"The firm {a} said on Monday that it will close.", "This is no advice.", f"A teaser tells of {a} and of its many rivals.", "All rights are reserved."]
        c, by, story, note, teaser, foot = lines
        html = f"<body><div><p>{c}</p></div><div><p>{by}</p><p>{story}</p><p>{note}</p></div><div><p>{teaser}</p></div><div><p>{foot}</p></div></body>"
        rows.append((str(i), "https://s.example", "s", html, "\n".join(lines)))
    df = spark.createDataFrame(rows, "id string, url string, source string, html string, body string")
    got = {(r["id"], r["line_no"]) for r in main_content.outside_lines(df).collect()}
    assert got == {(str(i), n) for i in range(8) for n in (0, 5)}
    for r in main_content.main_text(df).collect():
        assert "Cookies" not in r["main_text"] and "rights" not in r["main_text"] and "By Ann" in r["main_text"] and "no advice" in r["main_text"]


def test_tolerant_parser():
    for html in ("", "<", "</p></div>", "<div><p>a<p>b</div><td>c", "<!-- x", "<script>a<b", "<a href='x'>l</a><b>t", "<p " + "x" * 5000):
        parent, _, blocks, _ = main_content.tree(html)
        assert all(0 <= b[0] < len(parent) for b in blocks)
    deep = "<div>" * 5000 + "text" + "</div>" * 5000 + "<p>" + "<div>" * 5000 + "beside"
    parent, tags, blocks, _ = main_content.tree(deep)
    assert [b[1] for b in blocks] == ["text", "beside"]
    runs, subtrees = main_content.subtree_hashes(parent, tags, blocks, [5, 7])
    assert subtrees[1] and len(set(subtrees)) > 1
    verdict, _ = main_content.judged_blocks(parent, tags, [b[0] for b in blocks], [2, 0], [9, 1], runs, subtrees, {runs[1]})
    assert verdict == [main_content.KEEP, main_content.DELETE]


def test_subtrees_are_hashed_with_their_tags_and_children():
    def top(html):
        parent, tags, blocks, _ = main_content.tree(html)
        return main_content.subtree_hashes(parent, tags, blocks, main_content._fold([b[1] for b in blocks], False).view("uint64").tolist())[1][1]

    base = top("<div><p>one</p><ul><li>two</li></ul><p>three</p></div>")
    assert base == top("<div class=x><p>One!</p><ul><li>two</li></ul><p>three 7</p></div>")
    for other in ("<div><p>one</p><ol><li>two</li></ol><p>three</p></div>", "<div><p>three</p><ul><li>two</li></ul><p>one</p></div>", "<div><p>one</p><ul><li>four</li></ul><p>three</p></div>"):
        assert top(other) != base
    assert top("<div><p>one</p><a href=1>here</a></div>") == top("<div><p>one</p><a href=2>there</a></div>")


def test_nothing_is_deleted_where_nothing_recurs(spark):
    rows = [(str(i), "https://s.example/x", "s", page(i), body(i)) for i in range(8)]
    df = spark.createDataFrame(rows, "id string, url string, source string, html string, body string")
    assert main_content.outside_lines(df, recurs=100).count() == 0


def test_repeated_lines_against_brute_force(spark):
    long = "A very long legal notice " + "with many words, all the same everywhere, " * 60
    rows = []
    for i in range(12):
        lines = [f"Unique line number {chr(97 + i)}", "Share!" if i < 5 else "Other", long if i % 2 == 0 else "", "—", "SHARE" if i == 5 else "x"]
        rows.append((str(i), "s", "\n".join(lines), "k"))
    rows += [rows[0]] * 4 + [("z", None, "Share!\nShare!", "k"), ("y", "t", "Share!", "k"), ("n", "s", None, "k"), ("e", "s", "", "k")]
    df = spark.createDataFrame(rows, "id string, source string, body string, chunk string")
    ids = {}
    for i, s, b, _ in rows:
        for n, line in enumerate((b or "").split("\n")):
            k = "".join(c for c in line.lower() if c.isalnum())
            if k and s:
                ids.setdefault((s, k), set()).add((i, n))
    want = {x for v in ids.values() if len({i for i, _ in v}) >= 5 for x in v}
    got = {(r["id"], r["line_no"]) for r in repeated_lines.repeated_lines(repeated_lines.chunks(df)).collect()}
    assert got == want and len(want) > 10
    clean = {r["id"]: r["clean_body"] for r in repeated_lines.without_repeated_lines(df).collect()}
    assert clean["z"] == "Share!\nShare!" and clean["n"] is None and clean["0"].startswith("Unique") and "legal" not in clean["0"]
    assert repeated_lines.repeated_lines(repeated_lines.chunks(df.limit(0))).count() == 0


def test_chunks_settle_the_lines_that_are_one_chunk(spark, monkeypatch):
    often, whole = repeated_lines._often, []
    monkeypatch.setattr(repeated_lines, "_often", lambda pairs, key, least: (whole.append(pairs) if key == "line" else None) or often(pairs, key, least))
    shared = " ".join(f"word{i * i}" for i in range(900))
    rows = [(str(i), "s", "\n".join(["Share!", f"{shared} only here {i}", shared if i < 4 else "x" * i, f"share {i}"])) for i in range(6)]
    rows += [("p", "s", "Only a part: Share!"), ("t", "t", "Share!")]
    cut = repeated_lines.chunks(spark.createDataFrame(rows, "id string, source string, body string"))
    assert {tuple(r) for r in repeated_lines.repeated_lines(cut).collect()} == {(str(i), 0) for i in range(6)}
    assert [r["n_ids"] for r in repeated_lines.repeated_wholes(cut).collect()] == [6]
    counted = {r["line"] for r in whole[0].collect()}
    one = {r["line"] for r in cut.select(F.inline(F.arrays_zip("chunks", "wholes")).alias("chunk", "line")).where("chunk = line").collect()}
    # of the lines only those of several chunks are counted whole: the shared text, alone and with six endings
    assert len(counted) == 7 and len(one) > 7 and not counted & one
    assert repeated_lines.repeated_chunks(cut).count() > 3 and repeated_lines.repeated_chunks(cut, alone=True).count() == 1
