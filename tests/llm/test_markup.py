"""Markup: which syntaxes count as used, and what is left of a text."""

import time

import pytest
from pyspark.sql import functions as F

from upcurrent.llm.markup import Stripper, clean_text, keep, paired, syntaxes, used_markup

USED = [
    ("# Title", "markdown"), ("Title\n=====", "markdown"), ("Title\n---", "markdown"), ("so *very* good", "markdown"), ("so **very good** too", "markdown"), ("a __strong word__ here", "markdown"), ("~~gone~~", "markdown"),
    ("see [this](http://a.example/x)", "markdown"), ("![badge](http://a.example/x.svg)", "markdown"), ("go to <https://a.example>", "markdown"), ("a note. [^1]", "markdown"), ("[^1]: text", "markdown"), ("- one\n- two", "markdown"),
    ("+ one", "markdown"), ("1. one", "markdown"), ("- [x] done", "markdown"), ("> said", "markdown"), ("| a | b |\n| --- | :---: |\n| 1 | 2 |", "markdown"), ("```\nx\n```", "markdown"), ("run `x y` now", "markdown"),
    ("<p>hello</p>", "html"), ("a<br/>b", "html"), ("<!-- note -->", "html"), ("a &amp; b", "html"), ("it&#39;s", "html"), ('<img src="x" alt="y">', "html"), ("<DIV class='n'>x</DIV>", "html"), ("<pre><code>x</code></pre>", "html"),
    ("== Plan ==", "wiki"), ("h3. Steps", "wiki"), ("the '''bold''' one", "wiki"), ("[[Main Page]]", "wiki"), ("[[Page|label]]", "wiki"), ("[text|http://a.example]", "wiki"), ("{{Notice|x}}", "wiki"),
    ('{| class="w"\n! a !! b\n|-\n| 1 || 2\n|}', "wiki"), ("||a||b||", "wiki"), ("{{{\ncode\n}}}", "wiki"), ("{code}\nx\n{code}", "wiki"), ("|=a|=b|", "wiki"),
    (r"\section{One}", "latex"), ("\\begin{itemize}\n\\item a\n\\end{itemize}", "latex"), (r"so \textbf{bold} it is", "latex"), (r"needs $O(n \log n)$ steps", "latex"), (r"$$ s = \sum_{i} x_i $$", "latex"), (r"is \(\alpha_{1}\) here", "latex"),
]
NOT = [
    "plain words, nothing else.", "snake_case_name and __init__ and _x", "9 * 9 * 9 workers", "a < b && c > d", "Map<String, List<T>> instead", "Update Bot <bot@mail.example>", "from $5 to $7 per run", "Set $HOME and $PATH first",
    r"C:\builds\new\table", r"match \d+\.\d+ only", "The block [[tool.sources]] moved", "expands {{ matrix.target }} here", "see #4821 and #77", "C# and F# code", "pin geven==1.4.2 for now", "https://a.example/x_y_z*q*", "src/*.ts and lib/*.js",
    "[wip] start", "AT&T and R&D; done", "x = y[1](2)", "if [[ -f x ]]; then", "price <9.9 or >=1.0", "", "   ", None, "-5 degrees", "a -- b", "100% ~ 90%",
]


@pytest.mark.parametrize(("text", "markup"), USED)
def test_used(text, markup):
    assert syntaxes(text) == [markup]
    assert markup in syntaxes("Some words before.\r\n\r\n" + text.replace("\n", "\r\n") + "\r\n\r\nAnd some after.")


@pytest.mark.parametrize("text", NOT)
def test_not_used(text):
    assert syntaxes(text) == []


def test_code_hides_what_stands_in_it():
    assert syntaxes("```\n<p>**x** \\section{y} [[A|b]]\n```") == ["markdown"]
    assert syntaxes("{code}\n# x\n<b>y</b>\n{code}") == ["wiki"]
    assert syntaxes("<pre># x\n- y\n[[A|b]]</pre>") == ["html"]
    assert syntaxes("`<b>` and `$x^2$`") == ["markdown"]


def test_structure_survives():
    text = "# One\n\n<h2>Two</h2><ul><li>a &amp; b</li></ul>\n\n```py\nx = 1 < 2\n```\n\n| k | v |\n| --- | --- |\n| p | 1 |\n\n\\begin{equation}\nE = mc^2\n\\end{equation}\n\n1. first\n\nThe '''bold''' [link](http://a.example) and \\emph{words} go on for a while here."
    clean = Stripper(text).text()
    assert clean.split("\n\n") == ["# One", "## Two", "- a & b", "```\nx = 1 < 2\n```", "k | v\np | 1", "$$ E = mc^2 $$", "1. first", "The bold link and words go on for a while here."]


def test_line_blocks():
    assert keep([]) == [] and keep([0, 0]) == [False, False]
    lines = keep([2, 0, 0, 0, 0, 0, 30, 40, 0, 35, 0, 0, 0, 0, 3])
    assert not lines[0] and all(lines[6:10]) and not lines[14]


def test_long_and_odd_texts():
    for t in ("*" * 50000, "[" * 20000, "<" * 20000, "{{" * 20000, "`" * 30001, "$" * 20000, "\\begin{" * 5000, "| " * 20000, "=" * 50000, "a" * 300000, "\ue100\ue1031\ue103", "&" * 20000, "''" * 20000, "> " * 20000):
        Stripper(t).text()


def test_over_a_table(spark, rows):
    df = spark.createDataFrame([(1, "# x\n\n<b>y</b>"), (2, None), (3, ""), (1, "# x\n\n<b>y</b>"), (4, "plain")], "id bigint, body string").withColumn("markup", F.lit(1))
    assert rows(used_markup(df)) == [(1, "html"), (1, "html"), (1, "markdown"), (1, "markdown")]
    assert [r for r in rows(clean_text(df).select("id", "left_out")) if r[1]] == []
    out = rows(clean_text(df).select("id", "clean", "n_heading"))
    assert out == [(1, "# x\n\ny", 1), (1, "# x\n\ny", 1), (2, "", 0), (3, "", 0), (4, "plain", 0)]
    assert used_markup(df.limit(0)).count() == clean_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["$$\nx^2 + y^2\n$$", "\\[\nx^2\n\\]", "so that \\[\nx^2\n\\]", "$$ a = b\n+ c $$", "$$\n" + "x^2 +\n" * 2000 + "1\n$$", "with $$x^2$$ inside", "with $$ a = b $$ inside"])
def test_formulas_over_lines(text):
    assert syntaxes(text) == ["latex"]
    assert "latex" in syntaxes("Before it.\n\n" + text + "\n\nAnd after it.")


@pytest.mark.parametrize("text", ["kill $$\nand a_b\necho $$", "pid $$ > a_b; kill $$ now", "$$\nonly words\n$$ more", "\\[\n\\d+\n\\]", "$$ x^2 never closed", "\\[ x^2 never closed"])
def test_no_formulas_over_lines(text):
    assert syntaxes(text) == []


def test_formula_blocks_survive():
    text = "Here it is\n\n$$\nx^2 = y\n+ z\n$$\n\nso that \\[\na < b\n\\] holds for all the words that follow it here.\n\n- one"
    assert Stripper(text).text() == "Here it is\n\n$$ x^2 = y\n+ z $$\n\nso that\n$$ a < b $$\nholds for all the words that follow it here.\n\n- one"
    Stripper("\\[ x\n" * 20000).text()
    Stripper("$$ x\n" * 20001).text()
    Stripper("\\[ x\n" * 20000 + "\\d+\n\\]").text()


LONG = "words and more words " * 500  # ten times the caps there once were, and more
CAPPED = [
    ("'''" + LONG.strip() + "'''", "wiki"), ("{{{" + LONG + "}}}", "wiki"), ("{code:" + "title=x|" * 50 + "}" + LONG + "{code}", "wiki"), ("x \\(" + "a + " * 3000 + "b\\) y", "latex"), ("so $" + "a + " * 800 + "b$ is", "latex"),
    ("so $$" + "a + " * 6000 + "b$$ is", "latex"), ("\\[ " + "a + " * 6000 + "b \\] end", "latex"), (r"x \textbf{" + LONG * 3 + "} y", "latex"), (r"x \includegraphics[" + "a=b," * 1000 + "]{f} y", "latex"), ("<code>" + LONG * 6 + "</code>", "html"),
    ("<code>" + "<i x " * 600 + "</code>", "html"), ("text[^" + "n" * 400 + "] x", "markdown"), ("[^" + "n" * 400 + "]: x", "markdown"), ("[" + "d " * 500 + "]: https://a.example", "markdown"), ("**" + LONG.strip() + "**", "markdown"), ("__" + LONG.strip() + "__", "markdown"),
    ("it is \\(a = b\n + c\\) here", "latex"),
]


@pytest.mark.parametrize(("text", "markup"), CAPPED)
def test_markup_of_any_length(text, markup):
    assert syntaxes(text) == [markup]


def test_lines_without_any_end_cost_no_more():
    began = time.perf_counter()
    for t in (" '''a", "\\( a", "$$ a", "\\[ a", "{{{a", "{code}\n", "<code>", "[^a", r"\textbf[", r"\textbf{a", " $a", "__a b ", r"\begin{x}[", "# a" + " " * 9, "= a" + " " * 9):
        Stripper(t * 40000).text()
        Stripper(t * 40000 + " x\\)").text()
    Stripper("# a" + " " * 300000 + "b").text()
    Stripper("== a" + " " * 300000 + "b").text()
    assert time.perf_counter() - began < 60


def test_paired():
    mark = lambda x: "<" + x + ">" if x != "no" else None
    assert paired("a (b) (c (d) e (no) (f", "(", ")", mark) == "a <b> (c <d> e (no) (f"
    assert paired("$a$b$c$", "$", "$", mark) == "<a>b<c>" and paired("$no$x$", "$", "$", mark) in ("$no<x>", "$no$x$")
    assert paired("()", "(", ")", mark) == "()" and paired("", "(", ")", mark) == ""


def test_short_sentences_stay():
    s = Stripper("Short note.\n\n\n\nA long line of prose that surely makes a surge here.\n\n\n\n\nShort\n\n\n\n")
    assert s.text() == "Short note.\n\nA long line of prose that surely makes a surge here." and s.left_out == 5
