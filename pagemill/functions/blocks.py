"""What the nodes of a page mean, as Column expressions: kinds of paragraphs and of code, tables, lists, boxes, renderings.

A block has three readings: plain (inside a note or box), render (in a unit's text) and embed (in what is embedded). Nodes
stay an array in their page's row, so pages never meet.
"""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import let, strip

CODE_STRUCT = "struct<path:string,type:string,lang:string,code:string,kind:string,syntax_ok:boolean,issue:string,marked:boolean,error:string,pairs:array<struct<input:string,output:string>>>"
BLOCK = {
    "type": "string", "level": "int", "text": "string", "anchor": "string", "title": "string", "header": "array<string>", "rows": "array<array<string>>",
    "plain": "string", "render": "string", "embed": "string", "codes": f"array<{CODE_STRUCT}>",
}
BLOCK_STRUCT = f"struct<{','.join(f'{k}:{v}' for k, v in BLOCK.items())}>"
CODE_MAX_LINES = 8

# Names and patterns of the source material's markup and of its Korean typesetting. (?d): only \n ends a line.
LANG_ALIASES = {"textplain": "plaintext", "no-highlight": "plaintext"}
PYTHON_LANGS = ["python", "py", "python3", "pycon"]
SHELL_LANGS = ["bash", "sh", "shell", "console", "powershell", "bat"]
MARK_TAG = "\\[\\[/?MARK\\]\\]"
SHELL_LINE = "(?md)^(?:[A-Za-z]:\\\\[^>\\n]*>|[A-Za-z]:\\\\\\S*\\.exe\\b|\\$ |python3?\\s+\\S+\\.py)"
OUTPUT_LIKE = "(?md)^(?:\\d{4}-\\d{2}-\\d{2}\\s|Traceback \\(most recent call last\\)|=+ RESTART:)"
STRAY_FENCE = "^`{3}[\\w{}.\\-]*\\z"
IPYTHON_PROMPT = "(?md)^(?:In|Out) ?\\[\\d+\\]:"
CODE_TOKEN = "(?d)^\\s*(?:def|class|import|from|for|while|if|elif|else|return|print)\\b|\\w\\s*=[^=]|\\w\\(.*\\)|:\\s*$"
ERROR_LINE = "^([A-Z]\\w*(?:Error|Exception|Warning|Interrupt)|StopIteration)\\b"
SENTENCE_END = "[.!?다][\"'”’]?$"
CAPTION = "(?i)^(?:그림|표|figure|fig\\.|table)\\s*\\d"
IMAGE_MARK = "\\[이미지: [^\\]]*\\]"


def clean_lines(text: Column) -> Column:
    """Without white space around lines and around the whole."""
    return strip(F.array_join(F.transform(F.split(text, "\n", -1), strip), "\n"))


def _block(**fields: Column) -> Column:
    return F.struct(*[fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in BLOCK.items()])


def fenced(lang: Column, code: Column) -> Column:
    return F.concat(F.lit("```"), lang, F.lit("\n"), code, F.lit("\n```"))


# -- code -------------------------------------------------------------------------------------------------------------


def _rstrip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)\\s+\\z", "")


def session_pairs(code: Column) -> Column:
    """Inputs and outputs of a session with >>> prompts.

    Every line gets a role: prompt (>>>), more (... before any output), body (indented, or empty before an indented line,
    while an input that ended in a colon is open), else output. A prompt starts a pair; pairs without a word are left out.
    """
    indented = lambda x: x.rlike("^[ \\t]")
    # from the last line to the first: whether a line is indented or, if empty, the next line that is not
    zero = F.struct(F.lit(False).alias("below"), F.array().cast("array<boolean>").alias("out"))

    def look(a: Column, x: Column) -> Column:
        own = F.when((F.length(strip(x)) > 0) | indented(x), indented(x)).otherwise(a["below"])
        return F.struct(F.when(F.length(strip(x)) > 0, indented(x)).otherwise(a["below"]).alias("below"), F.array_append(a["out"], own).alias("out"))

    role = F.struct(F.lit(0).alias("n"), F.lit(False).alias("fresh"), F.lit(False).alias("open"), F.array().cast("array<struct<n:int,input:boolean,text:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        line, deep = x["line"], x["deep"]
        prompt = line.startswith(">>>")
        more = ~prompt & a["fresh"] & line.startswith("...")
        body = ~prompt & ~more & a["fresh"] & a["open"] & deep
        said = F.when(prompt | more, F.substring(line, F.lit(5), F.length(line))).otherwise(line)
        colon = _rstrip(said).endswith(":")
        is_input = prompt | more | body
        n = a["n"] + prompt.cast("int")
        return F.struct(
            n.alias("n"), F.when(is_input, F.lit(True)).otherwise(F.lit(False)).alias("fresh"),
            F.when(prompt, colon).when(more, a["open"] | colon).otherwise(body & a["open"]).alias("open"),
            F.array_append(a["out"], F.struct(n.alias("n"), is_input.alias("input"), said.alias("text"))).alias("out"),
        )

    def pairs(a: Column) -> Column:
        part = lambda k, given: F.array_join(F.transform(F.filter(a["out"], lambda r: (r["n"] == k) & (r["input"] == given)), lambda r: r["text"]), "\n")
        numbers = F.when(a["n"] > 0, F.sequence(F.lit(1), a["n"])).otherwise(F.array().cast("array<int>"))
        found = F.transform(numbers, lambda k: F.struct(part(k, F.lit(True)).alias("input"), _rstrip(part(k, F.lit(False))).alias("output")))
        return F.filter(found, lambda p: (F.length(strip(p["input"])) > 0) | (F.length(p["output"]) > 0))

    lines = F.split(code, "\n", -1)
    return let(lines, lambda x: let(F.reverse(F.aggregate(F.reverse(x), zero, look)["out"]), lambda deep: pairs(F.aggregate(F.transform(x, lambda line, i: F.struct(line.alias("line"), F.get(deep, i).alias("deep"))), role, step))))


def code_facts(lang: Column, raw: Column) -> Column:
    """What can be told of a code element without reading it as Python; check: what should be read so (null: nothing)."""
    alias = F.create_map(*[F.lit(x) for kv in LANG_ALIASES.items() for x in kv])
    named = F.coalesce(F.try_element_at(alias, lang), lang)
    named = F.when(F.length(named) > 0, named).otherwise("plaintext")

    def facts(x: Column) -> Column:
        lang, code = x["lang"], x["code"]
        python = lang.isin(PYTHON_LANGS)
        read = python | (lang == "plaintext")
        errors = F.filter(F.transform(F.split(code, "\n", -1), lambda r: F.regexp_extract(r, ERROR_LINE, 1)), lambda e: F.length(e) > 0)
        session = read & F.regexp_replace(code, "(?U)^\\s+", "").startswith(">>>")
        plain_kind = F.when(lang.isin(SHELL_LANGS) | code.rlike(SHELL_LINE), "shell").when(~read, "other").when(code.rlike(IPYTHON_PROMPT), "ipython").when(~session & (~python | code.rlike(OUTPUT_LIKE)), "output")
        pairs = F.when(session, session_pairs(code))
        return F.struct(lang.alias("lang"), code.alias("code"), (code != x["raw"]).alias("marked"), F.when(read, F.try_element_at(errors, F.lit(-1))).alias("error"), pairs.alias("pairs"), plain_kind.alias("kind"))

    def check(f: Column) -> Column:
        text = F.coalesce(F.array_join(F.transform(f["pairs"], lambda p: p["input"]), "\n"), f["code"])
        return F.struct(*[f[n].alias(n) for n in ("lang", "code", "marked", "error", "pairs", "kind")], F.when(f["kind"].isNull(), text).alias("check"))

    start = F.struct(named.alias("lang"), raw.alias("raw"), F.regexp_replace(raw, MARK_TAG, "").alias("code"))
    return let(let(start, facts), check)


def syntax_of(code: str | None) -> str | None:
    """ok, truncated (a block is missing) or syntax_error, as Python reads it; null for null."""
    if code is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(code)
        return "ok"
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return "truncated" if "expected an indented block" in str(getattr(e, "msg", e)) else "syntax_error"


@F.pandas_udf(ArrayType(StringType()))
def syntax_checks(codes: pd.Series) -> pd.Series:
    """syntax_of for arrays of codes: the one thing that only Python can tell."""
    return codes.map(lambda xs: None if xs is None else [syntax_of(x) for x in xs])


# so that no filter or projection takes the call along into a lambda, where Spark cannot run it
syntax_checks = syntax_checks.asNondeterministic()


def code_block(f: Column, syntax: Column) -> Column:
    """The block of a code element, from code_facts and its syntax."""
    session = f["pairs"].isNotNull()
    has_token = F.exists(F.split(f["code"], "\n", -1), lambda r: r.rlike(CODE_TOKEN))
    looks_like = F.when(syntax == "ok", F.when(session, "repl").otherwise("python")).when(session, "repl").when(has_token, "pseudo").otherwise("output")
    kind = F.coalesce(f["kind"], looks_like)
    judged = f["kind"].isNull() & (kind != "output")
    shown = F.filter(F.transform(F.split(f["code"], "\n", -1), lambda x: F.regexp_replace(x, "^(>>>|\\.\\.\\.) ?", "")), lambda x: F.length(strip(x)) > 0)
    type_ = F.when(session, "code_example").otherwise("code")
    entry = F.struct(
        F.lit("").alias("path"), type_.alias("type"), f["lang"].alias("lang"), f["code"].alias("code"), kind.alias("kind"), F.when(judged, syntax == "ok").alias("syntax_ok"),
        F.when(judged & (syntax != "ok"), syntax).alias("issue"), f["marked"].alias("marked"), f["error"].alias("error"), f["pairs"].alias("pairs"),
    )
    plain = fenced(f["lang"], f["code"])
    told = F.when(f["error"].isNotNull(), F.concat(F.lit("\n(오류 출력)\n"), f["error"])).otherwise("")
    return _block(type=type_, plain=plain, render=F.concat(plain, told), embed=F.array_join(F.slice(shown, 1, CODE_MAX_LINES), "\n"), codes=F.array(entry))


# -- other leaves -----------------------------------------------------------------------------------------------------


def _text_block(kind: Column, text: Column, plain: Column | None = None, render: Column | None = None, **more: Column) -> Column:
    bare = strip(F.regexp_replace(text, IMAGE_MARK, ""))
    return _block(type=kind, text=text, plain=text if plain is None else plain, render=text if render is None else render, embed=bare, **more)


def paragraph_block(text: Column, bold: Column) -> Column:
    """Caption, key point, subheading or paragraph."""

    def known(bare: Column) -> Column:
        ends = bare.rlike(SENTENCE_END)
        caption = bare.rlike(CAPTION) & (bold | ~ends)
        kind = F.when(caption, "caption").when(bold & ends, "key_point").when(bold, "subheading").otherwise("paragraph")
        return _text_block(kind, F.when(caption | bold, bare).otherwise(text), F.when(caption, bare).when(bold, F.concat(F.lit("**"), bare, F.lit("**"))).otherwise(text))

    return let(F.regexp_replace(text, "^\\*+|\\*+\\z", ""), known)


def heading_block(tag: Column, text: Column, anchor: Column) -> Column:
    level = F.substring(tag, 2, 1).cast("int")
    shown = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)
    return _text_block(F.lit("heading"), text, shown, shown, level=level, anchor=anchor)


def list_block(lines: Column) -> Column:
    one = lambda x: F.when(x["code"].isNotNull(), fenced(x["lang"], x["code"])).when(x["mark"].isNull(), "").otherwise(F.concat(F.repeat(F.lit("  "), x["depth"]), x["mark"], F.lit(" "), clean_lines(x["text"])))
    return let(F.array_join(F.transform(lines, one), "\n"), lambda text: _text_block(F.lit("list"), text, render=F.concat(F.lit("- "), text)))


def table_block(cells: Column, head: Column) -> Column:
    def of(rows: Column) -> Column:
        joined = F.transform(rows, lambda r: F.array_join(r, " | "))
        shown = F.array_join(joined, "\n")
        plain = F.array_join(F.transform(joined, lambda r: F.concat(F.lit("| "), r, F.lit(" |"))), "\n")
        none = F.array().cast("array<string>")
        return _block(type=F.lit("table"), header=F.when(head, F.coalesce(F.get(rows, F.lit(0)), none)).otherwise(none), rows=F.when(head, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows), plain=plain, render=shown, embed=shown)

    return let(F.transform(cells, lambda r: F.transform(r, lambda c: F.replace(clean_lines(c), F.lit("\n"), F.lit(" ")))), of)


def leaf_block(node: Column, facts: Column, syntax: Column) -> Column:
    """The block of a leaf; null if it holds nothing."""
    tag = node["tag"]

    def of_text(text: Column) -> Column:
        heading = F.when(F.length(text) > 0, heading_block(tag, text, node["anchor"]))
        paragraph = F.when((F.length(text) > 0) & ~text.rlike(STRAY_FENCE), paragraph_block(text, F.coalesce(node["bold"], F.lit(False))))
        loose = F.when(F.length(text) > 0, _text_block(F.lit("paragraph"), text))
        return F.when(tag == "p", paragraph).when(tag == "text", loose).otherwise(heading)

    return F.when(tag == "pre", code_block(facts, syntax)).when(tag == "list", list_block(node["lines"])).when(tag == "table", table_block(node["cells"], node["th"])).otherwise(let(clean_lines(node["text"]), of_text))


# -- notes and boxes --------------------------------------------------------------------------------------------------


def note_block(parts: Column) -> Column:
    text = F.array_join(F.transform(parts, lambda b: b["plain"]), "\n\n")
    quoted = lambda t: F.array_join(F.transform(F.split(t, "\n", -1), lambda x: _rstrip(F.concat(F.lit("> "), x))), "\n")
    return let(text, lambda t: F.when(F.length(t) > 0, _text_block(F.lit("note"), t, quoted(t))))


def placed(blocks: Column) -> Column:
    """Blocks whose codes have their place in front of their path."""
    path = lambda c, i: F.concat(i.cast("string"), F.when(F.length(c["path"]) > 0, F.concat(F.lit("."), c["path"])).otherwise(""))
    return F.transform(blocks, lambda b, i: b.withField("codes", F.transform(b["codes"], lambda c: c.withField("path", path(c, i)))))


def box_block(parts: Column) -> Column:
    """A box is named by its first part, if that is a subheading or key point; null if nothing else is in it."""
    first = F.get(parts, F.lit(0))
    named = F.coalesce(first["type"].isin("subheading", "key_point"), F.lit(False))
    inner = F.when(named, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)

    def of(x: Column) -> Column:
        title, rest = x["title"], x["rest"]
        join = lambda k, sep: F.array_join(F.transform(rest, lambda b: b[k]), sep)
        none = F.array().cast(BLOCK["codes"])
        codes = F.flatten(F.transform(placed(rest), lambda b: F.coalesce(b["codes"], none)))
        return F.when(F.size(rest) > 0, _block(
            type=F.lit("concept_box"), title=title, plain=F.concat(_rstrip(F.concat(F.lit("[개념] "), title)), F.lit("\n"), join("plain", "\n\n")),
            render=F.concat(F.lit("<"), title, F.lit(">\n"), join("render", "\n")), embed=strip(F.concat(title, F.lit("\n"), join("embed", "\n"))), codes=codes,
        ))

    return let(F.struct(F.when(named, first["text"]).otherwise("").alias("title"), inner.alias("rest")), of)


def nested(steps: Column) -> Column:
    """steps array<struct<op, tag, b>> -> blocks: what stands between an open and its close becomes one block.

    A fold with a stack of open notes and boxes; each holds the blocks it has so far, the last frame is the page's own.
    """
    frame = f"struct<tag:string,parts:array<{BLOCK_STRUCT}>>"
    none = F.array().cast(f"array<{BLOCK_STRUCT}>")
    zero = F.array(F.struct(F.lit("").alias("tag"), none.alias("parts"))).cast(f"array<{frame}>")
    fresh = lambda tag: F.struct(tag.alias("tag"), none.alias("parts")).cast(frame)

    def given(stack: Column, block: Column) -> Column:
        """The stack, its last frame with one block more."""
        last = F.element_at(stack, -1)
        more = F.struct(last["tag"].alias("tag"), F.concat(last["parts"], F.array(block)).alias("parts")).cast(frame)
        return F.when(block.isNull(), stack).otherwise(F.array_append(F.slice(stack, 1, F.size(stack) - 1), more))

    def step(stack: Column, x: Column) -> Column:
        last = F.element_at(stack, -1)
        whole = F.when(last["tag"] == "blockquote", note_block(last["parts"])).otherwise(box_block(last["parts"])).cast(BLOCK_STRUCT)
        under = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(1)))
        ended = F.when(F.size(stack) > 1, let(whole, lambda b: given(under, b))).otherwise(stack)
        return F.when(x["op"] == "open", F.array_append(stack, fresh(x["tag"]))).when(x["op"] == "close", ended).otherwise(given(stack, x["b"]))

    return F.aggregate(steps, zero, step, lambda stack: F.element_at(stack, 1)["parts"])


def blocks_of(nodes: Column, facts: Column, syntax: Column) -> Column:
    """The typed blocks of a page's nodes; facts and syntax: arrays of code_facts and syntax checks, by node."""
    steps = F.transform(nodes, lambda n, i: F.struct(n["op"].alias("op"), n["tag"].alias("tag"), F.when(n["op"] == "leaf", leaf_block(n, F.get(facts, i), F.get(syntax, i))).cast(BLOCK_STRUCT).alias("b")))
    flat = lambda s: F.transform(F.filter(s, lambda x: x["b"].isNotNull()), lambda x: x["b"])
    return let(steps, lambda s: placed(F.when(F.exists(s, lambda x: x["op"] != "leaf"), nested(s)).otherwise(flat(s))))
