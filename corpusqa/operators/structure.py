"""Function and block structure of a document, folded over its lines.

A document is one row, so its structure is one ``aggregate`` over its line
array: a stack of open blocks, closed by indentation or by braces.  Each line is
looked at once, no line pairs are formed and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusqa import values as V
from corpusqa.functions import text as TX
from corpusqa.functions.blanking import INSIDE, blank_braces, blank_python
from corpusqa.functions.patterns import AFTER_WORD, BEFORE_WORD, WORD, java
from corpusqa.operators.lines import issue

_CONTROL = ("if", "elif", "while", "for", "with", "try")
_DECISION = ("if", "elif", "while", "for", "try")
_LOOP = ("for", "while")
_FOLLOWER = ("elif", "else", "except", "finally")
_KEYWORD = rf"^(?:async[ \t]+)?(def|{'|'.join(_CONTROL)}|else|except|finally){AFTER_WORD}"

# A signature as far as it has been read: brackets open, its own bracket met, its own bracket closed,
# parameters, the current one has something, and the depth of an open lambda (0: none).
_SIGNATURE = ("depth", "begun", "done", "n", "filled", "lambda_at")
_SIGNATURE_TYPE = "struct<depth:int,begun:boolean,done:boolean,n:int,filled:boolean,lambda_at:int>"
_ENTRY = ("struct<kind:string,name:string,line:int,indent:int,complexity:int,"
          f"sig:{_SIGNATURE_TYPE},sig_open:boolean,inner:boolean>")
_FUNCTION = "struct<name:string,line:int,end_line:int,complexity:int,params:int>"
_NESTED = "struct<name:string,level:int,line:int>"
_LOOPS = "struct<line:int,inner_line:int>"


def _empty(element: str) -> Column:
    return F.array().cast(f"array<{element}>")


def _line_facts(text: Column) -> Column:
    """What the fold needs to know of each blanked line."""
    def facts(raw: Column, i: Column) -> Column:
        return TX.let(TX.strip(raw), lambda s: F.struct(
            (i + 1).alias("line"),
            (F.length(raw) - F.length(F.ltrim(raw, F.lit(" \t\x0c")))).alias("indent"),
            s.alias("s"),
            (F.length(F.regexp_replace(s, r"[^(\[{]+", ""))
             - F.length(F.regexp_replace(s, r"[^)\]}]+", ""))).alias("delta"),
            F.regexp_extract(s, _KEYWORD, 1).alias("kw"),
            F.regexp_count(s, F.lit(rf"(?<![{WORD}.])and{AFTER_WORD}")).alias("ands"),
        ))

    return F.transform(TX.lines(blank_python(text)), facts)


def _fold(facts: Column) -> Column:
    start = {"depth": F.lit(0), "cont": F.lit(False), "last": F.lit(0), "stack": _empty(_ENTRY)}
    found = {"functions": _FUNCTION, "nesting": _NESTED, "loops": _LOOPS}

    def closed(entries: Column, end: Column) -> Column:
        return F.transform(
            F.filter(entries, lambda e: e["kind"] == "def"),
            lambda e: F.struct(e["name"].alias("name"), e["line"].alias("line"),
                               end.alias("end_line"), e["complexity"].alias("complexity"),
                               e["sig"]["n"].alias("params")))

    def step(a: Column, x: Column) -> Column:
        logical = (~a["cont"]) & (a["depth"] == 0) & ~x["s"].startswith(INSIDE)
        return F.when(x["s"] == "", a).otherwise(
            TX.let(F.struct(logical.alias("logical"),
                            (a["depth"] + x["delta"]).alias("depth")),
                   lambda t: on_code(a, x, t)))

    def on_code(a: Column, x: Column, t: Column) -> Column:
        # A clause such as else belongs to the block at its own indentation.
        limit = F.when(x["kw"].isin(*_FOLLOWER), x["indent"]).otherwise(x["indent"] - 1)
        kept = F.when(t["logical"], F.filter(a["stack"], lambda e: e["indent"] <= limit)
                      ).otherwise(a["stack"])
        popped = F.when(t["logical"], F.filter(a["stack"], lambda e: e["indent"] > limit)
                        ).otherwise(_empty(_ENTRY))
        return TX.let(F.struct(kept.alias("kept"), popped.alias("popped")),
                      lambda s: on_stack(a, x, t, s["kept"], s["popped"]))

    def on_stack(a, x, t, kept, popped):
        opens = t["logical"] & x["kw"].isin("def", *_CONTROL)
        control = t["logical"] & x["kw"].isin(*_CONTROL)
        loop = t["logical"] & x["kw"].isin(*_LOOP)
        add = x["ands"] + F.when(t["logical"] & x["kw"].isin(*_DECISION), 1).otherwise(0)
        going = t["depth"] > 0
        carried = F.transform(kept, lambda e: F.struct(
            e["kind"].alias("kind"), e["name"].alias("name"), e["line"].alias("line"),
            e["indent"].alias("indent"), (e["complexity"] + add).alias("complexity"),
            F.when(e["sig_open"], _parameters(x["s"], e["sig"])).otherwise(e["sig"]).alias("sig"),
            (e["sig_open"] & going).alias("sig_open"), (e["inner"] | loop).alias("inner")))
        entry = F.struct(
            F.when(x["kw"].isin(*_LOOP), "loop").when(x["kw"] == "def", "def")
            .otherwise("control").alias("kind"),
            F.regexp_extract(x["s"], java(r"def\s+(\w+)"), 1).alias("name"),
            x["line"].alias("line"), x["indent"].alias("indent"),
            (x["ands"] + 1).alias("complexity"),
            F.when(x["kw"] == "def", _parameters(x["s"], _unread())).otherwise(_unread()).alias("sig"),
            ((x["kw"] == "def") & going).alias("sig_open"), F.lit(False).alias("inner"))
        levels = F.filter(
            F.transform(kept, lambda e, i: F.struct(
                F.when(e["kind"] == "def", e["name"]).alias("name"),
                (F.size(F.filter(F.slice(kept, i + 1, F.size(kept)),
                                 lambda c: c["kind"] != "def")) + 1).alias("level"),
                x["line"].alias("line"))),
            lambda r: r["name"].isNotNull() & (r["level"] > V.MAX_NESTING))
        outer = F.transform(
            F.filter(kept, lambda e: (e["kind"] == "loop") & ~e["inner"]),
            lambda e: F.struct(e["line"].alias("line"), x["line"].alias("inner_line")))
        return F.struct(
            t["depth"].alias("depth"), x["s"].endswith("\\").alias("cont"),
            x["line"].alias("last"),
            F.when(opens, F.concat(carried, F.array(entry))).otherwise(carried).alias("stack"),
            F.when(F.size(popped) > 0, F.concat(a["functions"], closed(popped, a["last"])))
            .otherwise(a["functions"]).alias("functions"),
            F.when(control & (F.size(kept) > V.MAX_NESTING), F.concat(a["nesting"], levels))
            .otherwise(a["nesting"]).alias("nesting"),
            F.when(loop, F.concat(a["loops"], outer)).otherwise(a["loops"]).alias("loops"),
        )

    def finish(a: Column) -> Column:
        return F.struct(
            F.concat(a["functions"], closed(a["stack"], a["last"])).alias("functions"),
            a["nesting"].alias("nesting"), a["loops"].alias("loops"),
            (a["depth"] == 0).alias("structure_ok"))

    return TX.let(TX.fold(facts, start, found, step), finish)


def _unread() -> Column:
    values = (F.lit(0), F.lit(False), F.lit(False), F.lit(0), F.lit(False), F.lit(0))
    return F.struct(*[v.alias(n) for n, v in zip(_SIGNATURE, values)])


def _parameters(line: Column, start: Column) -> Column:
    """Read one more line of a signature.  The parameters are counted as they end, so a signature without an end
    is no longer than its counters; ``*`` and ``/`` alone are none."""
    word = f"{BEFORE_WORD}lambda{AFTER_WORD}"
    parts = F.regexp_extract_all(line, F.lit(
        rf"{word}|[()\[\]{{}},:]|(?:(?!{word})[^()\[\]{{}},:])++"), F.lit(0))

    def step(a: Column, t: Column) -> Column:
        opening, closing = t.isin("(", "[", "{"), t.isin(")", "]", "}")
        depth = a["depth"] + F.when(opening, 1).when(closing, -1).otherwise(0)
        begun = a["begun"] | ((t == "(") & (a["depth"] == 0))
        ends = closing & a["begun"] & (depth == 0)
        parts_at = a["begun"] & (a["depth"] == 1)
        of_lambda = a["lambda_at"] == a["depth"]
        separates = parts_at & (((t == ",") & ~((a["lambda_at"] > 0) & of_lambda)) | ends)
        filled = parts_at & ~opening & ~closing & ~t.isin(",", ":") & ~TX.strip(t).isin("", "*", "/")
        lambda_at = (F.when((t == "lambda") & (a["lambda_at"] == 0), a["depth"])
                     .when((t == ":") & of_lambda, 0).when(closing & (depth < a["lambda_at"]), 0).otherwise(a["lambda_at"]))
        return F.when(a["done"], a).otherwise(F.struct(
            depth.alias("depth"), begun.alias("begun"), ends.alias("done"),
            (a["n"] + F.when(separates & a["filled"], 1).otherwise(0)).alias("n"),
            ((a["filled"] | filled) & ~separates).alias("filled"), lambda_at.alias("lambda_at")))

    return F.aggregate(parts, start, step)


def structure(text: Column) -> Column:
    """struct<functions, nesting, loops, structure_ok> of an indented source text."""
    def read(a: Column) -> Column:
        return F.struct(
            F.transform(a["functions"], lambda f: F.struct(
                f["name"].alias("name"), f["line"].alias("line"),
                f["end_line"].alias("end_line"),
                (f["end_line"] - f["line"] + 1).alias("lines"),
                f["params"].alias("params"),
                f["complexity"].alias("complexity"))).alias("functions"),
            a["nesting"].alias("nesting"), a["loops"].alias("loops"),
            a["structure_ok"].alias("structure_ok"))

    return TX.let(_fold(_line_facts(text)), read)


def functions(docs: DataFrame, id_cols: Sequence[str] = ("doc_id",),
              text_col: str = "text") -> DataFrame:
    """Rows ids, name, line, end_line, lines, params, complexity."""
    return docs.select(*id_cols, F.inline(structure(F.col(text_col))["functions"]))


def deep_nesting(docs: DataFrame, id_cols: Sequence[str] = ("doc_id",),
                 text_col: str = "text") -> DataFrame:
    """Rows ids, name (of the function), level, line for blocks deeper than allowed."""
    return docs.select(*id_cols, F.inline(structure(F.col(text_col))["nesting"]))


def structure_issues(s: Column) -> Column:
    """array<issue> of a ``structure`` struct: function and nesting smells, nested loops."""
    def smell(s: Column, name: str, field: str, limit: int, message: str) -> Column:
        return F.transform(F.filter(s["functions"], lambda f: f[field] > limit), lambda f: issue(
            V.CODE_SMELLS, name, F.format_string(message, f["name"], f[field]),
            "medium", f["line"]))

    # Bound once: five lists are read from it.
    return TX.let(s, lambda s: F.concat(
        smell(s, "too_many_parameters", "params", V.MAX_PARAMETERS,
              "Function '%s' has %d parameters"),
        smell(s, "long_function", "lines", V.MAX_FUNCTION_LINES,
              "Function '%s' is approx. %d lines long"),
        smell(s, "high_complexity", "complexity", V.MAX_COMPLEXITY,
              "Function '%s' has high cyclomatic complexity (%d)"),
        F.transform(s["nesting"], lambda n: issue(
            V.CODE_SMELLS, "deep_nesting",
            F.format_string("Deep nesting (level %d) in function '%s'", n["level"], n["name"]),
            "high", n["line"])),
        nested_loop_issues(s["loops"]),
    ))


def nested_loop_issues(loops: Column) -> Column:
    return F.transform(loops, lambda r: issue(
        V.PERFORMANCE, "nested_loops",
        F.format_string("Nested loops detected (outer loop at line %d, inner at line %d)",
                        r["line"], r["inner_line"]), "high", r["line"]))


# ------------------------------------------------------------ brace languages

_JS_FUNCTION = (rf"{BEFORE_WORD}function\s+[{WORD}]++"
                rf"|{BEFORE_WORD}const\s+[{WORD}]++\s*+=\s*+(?:async\s*+)?\([^\n]*\)"
                rf"|{BEFORE_WORD}[{WORD}]++\s*+=\s*+function{AFTER_WORD}")
_BRACE_ENTRY = ("struct<head:string,line:int,depth:int,paren:int,open:boolean,inner:boolean>")
_BRACE_BLOCK = "struct<head:string,line:int,end_line:int>"


_LOOP_HEADS = sorted({w for words in V.LOOP_WORDS.values() for w in words})


def _loop_words(words: Sequence[str]) -> str:
    return f"{BEFORE_WORD}(?:{'|'.join(words)}){AFTER_WORD}"


def _brace_tokens(text: Column, lang: Column, functions: str) -> Column:
    """Loop words, function heads and punctuation of a blanked text, in order."""
    def extract(words: Sequence[str]) -> Column:
        return F.regexp_extract_all(
            blanked, F.lit(rf"{functions}|{_loop_words(words)}|[\n{{}};()]"), F.lit(0))

    blanked = blank_braces(text)
    tokens = extract(V.DEFAULT_LOOP_WORDS)
    by_words: dict[tuple[str, ...], list[str]] = {}
    for name, words in V.LOOP_WORDS.items():
        by_words.setdefault(words, []).append(name)
    for words, names in by_words.items():
        if words != V.DEFAULT_LOOP_WORDS:
            tokens = F.when(lang.isin(*names), extract(words)).otherwise(tokens)
    return tokens


def brace_structure(text: Column, lang: Column) -> Column:
    """struct<blocks, loops>: function blocks, and loops that hold a loop."""
    parts = _brace_tokens(text, lang, _JS_FUNCTION)

    def is_loop(head: Column) -> Column:
        return head.isin(*_LOOP_HEADS)

    start = {"line": F.lit(1), "depth": F.lit(0), "paren": F.lit(0), "stack": _empty(_BRACE_ENTRY)}
    found = {"blocks": _BRACE_BLOCK, "loops": _LOOPS}

    def state(a, **changed):
        names = ("line", "depth", "paren", "stack", "blocks", "loops")
        return F.struct(*[changed.get(n, a[n]).alias(n) for n in names])

    def entry(e, **changed):
        names = ("head", "line", "depth", "paren", "open", "inner")
        return F.struct(*[changed.get(n, e[n]).alias(n) for n in names])

    def on_open(a):
        return state(a, depth=a["depth"] + 1, stack=F.transform(a["stack"], lambda e: entry(
            e, open=F.lit(True), depth=F.when(e["open"], e["depth"]).otherwise(a["depth"]))))

    def on_close(a):
        depth = a["depth"] - 1
        ended = F.filter(a["stack"], lambda e: e["open"] & (e["depth"] >= depth))
        return state(
            a, depth=depth,
            stack=F.filter(a["stack"], lambda e: F.when(
                e["open"], e["depth"] < depth).otherwise(e["depth"] <= depth)),
            blocks=F.concat(a["blocks"], F.transform(
                F.filter(ended, lambda e: ~is_loop(e["head"])),
                lambda e: F.struct(e["head"].alias("head"), e["line"].alias("line"),
                                   a["line"].alias("end_line")))))

    def on_header(a, t):
        inside = F.filter(a["stack"], lambda e: is_loop(t) & is_loop(e["head"]) & ~e["inner"])
        new = F.struct(t.alias("head"), a["line"].alias("line"), a["depth"].alias("depth"),
                       a["paren"].alias("paren"), F.lit(False).alias("open"),
                       F.lit(False).alias("inner"))
        return state(
            a,
            line=a["line"] + F.length(F.regexp_replace(t, r"[^\n]+", "")),
            stack=F.concat(F.transform(a["stack"], lambda e: entry(
                e, inner=e["inner"] | is_loop(t))), F.array(new)),
            loops=F.concat(a["loops"], F.transform(inside, lambda e: F.struct(
                e["line"].alias("line"), a["line"].alias("inner_line")))))

    def step(a, t):
        return (
            F.when(t == "\n", state(a, line=a["line"] + 1))
            .when(t == "{", on_open(a))
            .when(t == "}", on_close(a))
            .when(t == "(", state(a, paren=a["paren"] + 1))
            .when(t == ")", state(a, paren=a["paren"] - 1))
            # A statement that ends before any brace: its header has no block.
            .when(t == ";", state(a, stack=F.filter(
                a["stack"], lambda e: e["open"] | (e["paren"] < a["paren"]))))
            .otherwise(on_header(a, t)))

    return TX.let(TX.fold(parts, start, found, step), lambda a: F.struct(
        a["blocks"].alias("blocks"), a["loops"].alias("loops")))


def brace_functions(structure: Column) -> Column:
    """array<struct<name, line, end_line, lines>> of braced function definitions."""
    name = java(r"(?:function\s+|const\s+)?(\w+)")
    return F.transform(structure["blocks"], lambda b: F.struct(
        F.regexp_extract(b["head"], f"^{name}", 1).alias("name"), b["line"].alias("line"),
        b["end_line"].alias("end_line"), (b["end_line"] - b["line"]).alias("lines")))


def brace_function_issues(structure: Column) -> Column:
    long = F.filter(brace_functions(structure), lambda f: f["lines"] > V.MAX_FUNCTION_LINES)
    return F.transform(long, lambda f: issue(
        V.CODE_SMELLS, "long_function",
        F.format_string("Function '%s' is %d lines long", f["name"], f["lines"]),
        "medium", f["line"]))


def block_extents(docs: DataFrame, header: str, id_cols: Sequence[str] = ("doc_id",),
                  text_col: str = "text", indent: str = " \t") -> DataFrame:
    """Blocks of any indented text: rows ids, line, end_line, header.

    A block runs from a line that fits ``header`` (a Java pattern on the stripped
    line) to the last filled line before the next line that is indented no
    deeper.  ``indent`` is the set of characters counted as indentation.
    """
    item = "struct<line:int,indent:int,head:string>"
    block = "struct<line:int,end_line:int,head:string>"
    facts = F.filter(
        F.transform(TX.lines(F.col(text_col)), lambda raw, i: F.struct(
            (i + 1).alias("line"),
            (F.length(raw) - F.length(F.ltrim(raw, F.lit(indent)))).alias("indent"),
            TX.strip(raw).alias("head"))),
        lambda x: x["head"] != "")
    start = {"last": F.lit(0), "stack": _empty(item)}

    def ended(entries: Column, end: Column) -> Column:
        return F.transform(entries, lambda e: F.struct(
            e["line"].alias("line"), end.alias("end_line"), e["head"].alias("head")))

    def step(a: Column, x: Column) -> Column:
        kept = F.filter(a["stack"], lambda e: e["indent"] < x["indent"])
        popped = F.filter(a["stack"], lambda e: e["indent"] >= x["indent"])
        return F.struct(
            x["line"].alias("last"),
            F.when(x["head"].rlike(header), F.concat(kept, F.array(x))).otherwise(kept).alias("stack"),
            F.when(F.size(popped) > 0, F.concat(a["blocks"], ended(popped, a["last"])))
            .otherwise(a["blocks"]).alias("blocks"))

    found = TX.let(TX.fold(facts, start, {"blocks": block}, step),
                   lambda a: F.concat(a["blocks"], ended(a["stack"], a["last"])))
    return docs.select(*id_cols, F.inline(found)).withColumnRenamed("head", "header")
