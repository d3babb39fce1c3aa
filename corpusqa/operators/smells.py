"""Smells of single documents that need a scanner: complex conditions, magic numbers, global variables, empty handlers.

The scan runs over blanked code, so strings and comments neither count nor hide anything.  Indented texts are folded by
the line, texts with braces by the token; the state is a few counters and a stack of open conditions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusqa import values as V
from corpusqa.functions import text as TX
from corpusqa.functions.blanking import INSIDE, blank_braces, blank_python
from corpusqa.functions.locate import matches
from corpusqa.functions.patterns import AFTER_WORD, BEFORE_WORD, WORD
from corpusqa.operators.lines import issue

_FOUND = "struct<type:string,line:int>"
# Digits with their exponent, fraction, base and suffix; a name that ends in digits is none.
_LITERAL = rf"(?<![{WORD}.])(?:0[xXoObB][0-9a-fA-F_]++|[0-9][0-9_]*+(?:\.[0-9_]*+)?(?:[eE][+-]?[0-9]++)?|\.[0-9]++)[a-zA-Z]*+"
_DECLARED = {s.name: s for s in V.DECLARED_SMELLS}


def _magic(literal: Column) -> Column:
    return ~literal.isin(*V.PLAIN_NUMBERS)


def _hit(name: str, line: Column) -> Column:
    return F.struct(F.lit(name).alias("type"), line.cast("int").alias("line"))


def _none() -> Column:
    return F.array().cast(f"array<{_FOUND}>")


def _one_if(condition: Column, name: str, line: Column) -> Column:
    return F.when(condition, F.array(_hit(name, line))).otherwise(_none())


# ------------------------------------------------------------ indented texts

def _python_lines(text: Column) -> Column:
    def facts(raw: Column, i: Column) -> Column:
        return TX.let(TX.strip(raw), lambda s: F.struct(
            (i + 1).alias("line"),
            (F.length(raw) - F.length(F.ltrim(raw, F.lit(" \t\x0c")))).alias("indent"), s.alias("s"),
            (F.length(F.regexp_replace(s, r"[^(\[{]+", ""))
             - F.length(F.regexp_replace(s, r"[^)\]}]+", ""))).alias("delta"),
            F.regexp_count(s, F.lit(rf"{BEFORE_WORD}(?:and|or){AFTER_WORD}")).alias("ops"),
            F.size(F.filter(F.regexp_extract_all(s, F.lit(_LITERAL), F.lit(0)), _magic)).alias("magic"),
            s.rlike(rf"^(?:if|elif|while){AFTER_WORD}").alias("condition"),
            s.rlike(rf"^except{AFTER_WORD}").alias("handler"),
            F.regexp_extract(s, rf"^except{AFTER_WORD}[^:]*+:\s*+(.*)$", 1).alias("rest"),
            s.isin("pass", "...").alias("idle"),
            s.rlike(rf"^[A-Z_][A-Z0-9_]*+\s*+(?::[^=]*+)?=(?!=)").alias("constant"),
            s.rlike(rf"^[{WORD}]++\s*+(?::[^=]*+)?=(?!=)").alias("assigns")))

    return F.transform(TX.lines(blank_python(text)), facts)


def _python(text: Column) -> Column:
    start = {"depth": F.lit(0), "going": F.lit(False), "constant": F.lit(False), "globals": F.lit(0),
             # the condition that is open: its line (0: none) and operators
             "at": F.lit(0), "ops": F.lit(0),
             # the handler that is open: its line (0: none) and indent; it has done nothing but pass
             "handler": F.lit(0), "margin": F.lit(0), "idle": F.lit(False)}
    found = {"found": _FOUND}

    def step(a: Column, x: Column) -> Column:
        first = ~a["going"] & ~x["s"].startswith(INSIDE)
        t = F.struct(first.alias("first"), (a["depth"] + x["delta"]).alias("depth"),
                     (((a["depth"] + x["delta"]) > 0) | x["s"].endswith("\\")).alias("going"))
        return F.when(x["s"] == "", a).otherwise(TX.let(t, lambda t: on_code(a, x, t)))

    def on_code(a: Column, x: Column, t: Column) -> Column:
        constant = F.when(t["first"], x["constant"]).otherwise(a["constant"])
        at = F.when(t["first"], F.when(x["condition"], x["line"]).otherwise(0)).otherwise(a["at"])
        ops = F.when(t["first"], 0).otherwise(a["ops"]) + x["ops"]
        complex_ = (at > 0) & ~t["going"] & (ops > V.MAX_CONDITION_OPERATORS)
        is_global = t["first"] & (x["indent"] == 0) & x["assigns"] & ~x["constant"]
        globals_ = a["globals"] + is_global.cast("int")
        # A handler ends at the first line that is indented no deeper.
        ended = t["first"] & (a["handler"] > 0) & (x["indent"] <= a["margin"])
        opens = t["first"] & x["handler"]
        handler = F.when(opens, x["line"]).when(ended, 0).otherwise(a["handler"])
        idle = (F.when(opens, x["rest"].isin("", "pass", "...")).when(ended, False)
                .otherwise(a["idle"] & x["idle"]))
        return F.struct(
            t["depth"].alias("depth"), t["going"].alias("going"), constant.alias("constant"), globals_.alias("globals"),
            F.when(t["going"], at).otherwise(0).alias("at"), ops.alias("ops"),
            handler.alias("handler"), F.when(opens, x["indent"]).otherwise(a["margin"]).alias("margin"), idle.alias("idle"),
            F.concat(a["found"], _one_if(complex_, "complex_conditional", at),
                     _one_if(ended & a["idle"], "empty_catch", a["handler"]),
                     _one_if(is_global & (globals_ > V.MAX_GLOBALS), "global_variable", x["line"]),
                     F.when(~constant, F.array_repeat(_hit("magic_number", x["line"]), x["magic"])).otherwise(_none()),
                     ).alias("found"))

    return TX.let(TX.fold(_python_lines(text), start, found, step), lambda a: F.concat(
        a["found"], _one_if((a["handler"] > 0) & a["idle"], "empty_catch", a["handler"])))


# ----------------------------------------------------------- texts with braces

_TOKEN = (rf"\n|&&|\|\||[(){{}};]|{BEFORE_WORD}(?:if|while|const|var|let){AFTER_WORD}|{_LITERAL}")
_EMPTY_CATCH = rf"{BEFORE_WORD}catch\s*+(?:\([^(){{}}]*+\)\s*+)?\{{\s*+\}}"
_CONDITION = "struct<line:int,paren:int,ops:int>"


def _braces(text: Column) -> Column:
    start = {"line": F.lit(1), "depth": F.lit(0), "paren": F.lit(0), "globals": F.lit(0), "statement": F.lit(""),
             "word": F.lit(0), "open": F.array().cast(f"array<{_CONDITION}>")}
    found = {"found": _FOUND}
    names = (*start, "found")

    def state(a: Column, **changed: Column) -> Column:
        return F.struct(*[changed.get(n, a[n]).alias(n) for n in names])

    def condition(c: Column, more: int) -> Column:
        return F.struct(c["line"].alias("line"), c["paren"].alias("paren"), (c["ops"] + more).alias("ops"))

    def on_open(a: Column) -> Column:
        new = F.struct(a["word"].alias("line"), (a["paren"] + 1).alias("paren"), F.lit(0).alias("ops"))
        return state(a, paren=a["paren"] + 1, word=F.lit(0),
                     open=F.when(a["word"] > 0, F.concat(a["open"], F.array(new))).otherwise(a["open"]))

    def on_close(a: Column) -> Column:
        ended = F.filter(a["open"], lambda c: (c["paren"] >= a["paren"]) & (c["ops"] > V.MAX_CONDITION_OPERATORS))
        return state(a, paren=a["paren"] - 1, open=F.filter(a["open"], lambda c: c["paren"] < a["paren"]),
                     found=F.concat(a["found"], F.transform(ended, lambda c: _hit("complex_conditional", c["line"]))))

    def on_declared(a: Column, t: Column) -> Column:
        is_global = (a["depth"] == 0) & (a["paren"] == 0) & (t != "const")
        n = a["globals"] + is_global.cast("int")
        return state(a, statement=t, globals=n, found=F.concat(
            a["found"], _one_if(is_global & (n > V.MAX_GLOBALS), "global_variable", a["line"])))

    def step(a: Column, t: Column) -> Column:
        blank, none = F.lit(""), F.lit(0)
        return (F.when(t == "\n", state(a, line=a["line"] + 1))
                .when(t == "(", on_open(a)).when(t == ")", on_close(a))
                .when(t == "{", state(a, depth=a["depth"] + 1, statement=blank, word=none))
                .when(t == "}", state(a, depth=a["depth"] - 1, statement=blank, word=none))
                .when(t == ";", state(a, statement=F.when(a["paren"] == 0, blank).otherwise(a["statement"]), word=none))
                .when(t.isin("&&", "||"), state(a, open=F.transform(a["open"], lambda c: condition(c, 1))))
                .when(t.isin("if", "while"), state(a, word=a["line"]))
                .when(t.isin("const", "var", "let"), on_declared(a, t))
                .otherwise(state(a, found=F.concat(a["found"], _one_if(
                    (a["statement"] != "const") & _magic(t), "magic_number", a["line"])))))

    def read(code: Column) -> Column:
        caught = F.transform(matches(code, _EMPTY_CATCH), lambda m: _hit("empty_catch", m["line"]))
        tokens = F.regexp_extract_all(code, F.lit(_TOKEN), F.lit(0))
        return TX.let(TX.fold(tokens, start, found, step), lambda a: F.concat(a["found"], caught))

    return TX.let(blank_braces(text), read)


def declared_smells(text: Column, lang: Column) -> Column:
    """array<issue> of the smells in ``values.DECLARED_SMELLS``.

    * complex_conditional: a condition with more than ``MAX_CONDITION_OPERATORS`` logical operators;
    * magic_number: each number but ``PLAIN_NUMBERS`` outside the value of a constant;
    * global_variable: each variable set at the outermost level beyond ``MAX_GLOBALS`` of them;
    * empty_catch: a handler that does nothing.
    """
    def issues(found: Column) -> Column:
        def field(name: str) -> Column:
            table = F.create_map(*[F.lit(x) for s in V.DECLARED_SMELLS for x in (s.name, getattr(s, name))])
            return table

        return F.transform(found, lambda h: issue(
            V.CODE_SMELLS, h["type"], field("description")[h["type"]], field("severity")[h["type"]], h["line"]))

    braced = [n for n in V.FINE_LANGUAGES if n in V.LINE_MARKERS and n not in ("Python", "Ruby")] + ["TypeScript", "C/C++"]
    return TX.let(F.when(lang == "Python", _python(text)).when(lang.isin(*braced), _braces(text)).otherwise(_none()), issues)


def smell_scan(docs: DataFrame, lang: Column, id_cols: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Issue rows: ids, category, type, description, severity, line, context (null)."""
    return docs.select(*id_cols, F.inline(declared_smells(F.col(text_col), lang)))
