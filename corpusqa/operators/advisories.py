"""Dependencies against a table of advisories: package and version range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from corpusqa import values as V
from corpusqa.functions import text as TX

_SEP = "\u0001"
#: Epoch, release, pre-release and its number, post-release (``-1`` or by name) and its number, development release and its
#: number.  A local part after ``+`` does not order; ``SNAPSHOT`` is a development release.
_VERSION = (r"^v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[._-]?(alpha|a|beta|b|preview|pre|rc|c)[._-]?(\d*))?"
            r"(?:-(\d+)|[._-]?(post|rev|r)[._-]?(\d*))?(?:[._-]?(dev|snapshot)[._-]?(\d*))?"
            r"(?:\+[a-z0-9]+(?:[._-][a-z0-9]+)*)?$")
_PRE = {"a": 0, "alpha": 0, "b": 1, "beta": 1, "c": 2, "rc": 2, "pre": 2, "preview": 2}
_NUMBER = "decimal(38,0)"
_CLAUSE = r"^\s*(<=|>=|===?|!=|~=|<|>)\s*(\S+?)\s*$"


def parse_requirements(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add package, operator and installed version of a requirement line.

    Comment, option and blank lines are left out.  Package names compare in lower
    case with ``_`` and ``.`` read as ``-``.
    """
    text = F.regexp_replace(TX.strip(F.col(line)), r"\s*(?:#|;).*$", "")
    name = F.regexp_extract(text, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    spec = r"^[A-Za-z0-9][A-Za-z0-9._-]*\s*(?:\[[^\]]*\])?\s*(===?|>=|<=|~=|!=|<|>)\s*([^,\s]+)"
    return lines.select(
        "*",
        F.regexp_replace(F.lower(name), "[._]", "-").alias("package"),
        F.regexp_extract(text, spec, 1).alias("operator"),
        F.regexp_extract(text, spec, 2).alias("installed"),
    ).filter(F.col("package") != "")


def version(text: Column) -> Column:
    """struct<key, release> of a version, null if it cannot be read.

    ``key`` is a struct of numbers that compares as the version does: development releases before
    pre-releases before the release before post-releases, trailing zeros left out.  ``release`` has all its numbers.
    A number of more than 38 digits cannot be read.
    """
    parts = F.split(F.regexp_replace(F.lower(TX.strip(text)), _VERSION, _SEP.join(f"${i}" for i in range(1, 10)) + _SEP), _SEP)
    rank = F.create_map(*(F.lit(x) for kv in _PRE.items() for x in kv))

    def numbers(t: Column) -> Column:
        return F.transform(F.split(t, "[.]"), lambda x: x.try_cast(_NUMBER))

    def read(p: Column) -> Column:
        def number(i: int) -> Column:
            return F.when(p[i] == "", F.lit(0).cast(_NUMBER)).otherwise(p[i].try_cast(_NUMBER))

        pre, post, dev = p[2] != "", (p[4] != "") | (p[5] != ""), p[7] != ""
        key = F.struct(
            number(0).alias("epoch"), numbers(F.regexp_replace(p[1], r"(?:\.0++)++$", "")).alias("release"),
            F.when(pre, rank[p[2]]).when(dev & ~post, -1).otherwise(3).alias("pre"), number(3).alias("pre_n"),
            F.when(post, F.when(p[4] != "", number(4)).otherwise(number(6))).otherwise(F.lit(-1).cast(_NUMBER)).alias("post"),
            F.when(dev, 0).otherwise(1).alias("dev"), number(8).alias("dev_n"))
        return F.when(F.size(p) == 10, F.struct(key.alias("key"), numbers(p[1]).alias("release")))

    def sound(v: Column) -> Column:
        k = v["key"]
        known = F.forall(v["release"], lambda x: x.isNotNull())
        for n in ("epoch", "pre_n", "post", "dev_n"):
            known = known & k[n].isNotNull()
        return F.when(known, v)

    return TX.let(TX.let(parts, read), sound)


def ranges(affected: Column) -> Column:
    """array of alternatives, each an array of clauses, of a range such as ``>=1.0,<1.4|==2.*``.

    A clause is struct<op, any, bound, prefix>; ``bound`` is null where it cannot be read, ``prefix`` holds the numbers
    that a version of the family begins with.
    """
    def clause(c: Column) -> Column:
        def read(s: Column) -> Column:
            family = s["text"].endswith(".*")
            bare = F.when(family, F.regexp_replace(s["text"], r"\.\*$", "")).otherwise(s["text"])
            return TX.let(version(bare), lambda v: F.struct(
                F.when(family, F.concat(s["op"], F.lit(".*"))).otherwise(s["op"]).alias("op"),
                F.trim(c).isin("", "*").alias("any"),
                F.when(family & ~s["op"].isin("==", "!="), None)
                .when((s["op"] == "~=") & (F.size(v["release"]) < 2), None).otherwise(v["key"]).alias("bound"),
                F.when(s["op"] == "~=", F.slice(v["release"], 1, F.greatest(F.size(v["release"]) - 1, F.lit(0))))
                .otherwise(v["release"]).alias("prefix")))

        return TX.let(F.struct(F.regexp_extract(c, _CLAUSE, 1).alias("op"),
                               F.regexp_extract(c, _CLAUSE, 2).alias("text")), read)

    return F.transform(F.split(affected, r"\|"), lambda alt: F.transform(F.split(alt, ","), clause))


def meets(v: Column, alternatives: Column) -> Column:
    """Does a ``version`` meet every clause of one of the ``ranges``?  Null: something that decides cannot be read."""
    def clause(c: Column) -> Column:
        key, bound, n = v["key"], c["bound"], F.size(c["prefix"])
        padded = F.slice(F.concat(v["release"], F.array_repeat(F.lit(0).cast(_NUMBER), n)), F.lit(1), n)
        family = (key["epoch"] == bound["epoch"]) & (padded == c["prefix"])
        op = c["op"]
        return (F.when(c["any"], True).when(op == "<", key < bound).when(op == "<=", key <= bound)
                .when(op == ">", key > bound).when(op == ">=", key >= bound)
                .when(op == "~=", (key >= bound) & family)
                .when(op == "==.*", family).when(op == "!=.*", ~family)
                .when(op == "!=", key != bound).when(op.isin("==", "==="), key == bound))

    return F.exists(alternatives, lambda alt: F.forall(alt, clause))


def in_range(installed: Column, affected: Column) -> Column:
    """Is a version in a range such as ``>=1.0,<1.4``?  Null where either side cannot be read and that decides.

    Alternatives are separated by ``|``. ``~=1.4.2`` is ``>=1.4.2,==1.4.*``; ``*`` and a blank clause are any version.
    """
    return TX.let(version(installed), lambda v: TX.let(ranges(affected), lambda r: meets(v, r)))


AFFECTED, UNREADABLE = "affected", "unreadable"


def advisory_match(installed: DataFrame, advisories: DataFrame,
                   ignored: Sequence[str] = V.IGNORED_ADVISORIES) -> DataFrame:
    """Findings: the installed rows whose version an advisory affects, with ``answer``: ``affected``, or
    ``unreadable`` where version or range cannot be read, which is reported and not passed over.

    An equi join on the package; Spark broadcasts the advisories when their size
    allows, and splits a package that many projects use when it does not.  Versions and ranges are parsed
    once each, before the join.
    """
    live = advisories.filter(~F.col("id").isin(*ignored)) if ignored else advisories
    met = installed.withColumn("_version", version(F.col("installed"))).join(
        live.withColumn("_ranges", ranges(F.col("affected"))), "package")
    answer = F.struct(meets(F.col("_version"), F.col("_ranges")).alias("met"))
    rest = [c for c in met.columns if c not in ("_version", "_ranges")]
    found = met.select(*rest, TX.one_row(answer, lambda a: ~a["met"].eqNullSafe(F.lit(False))))
    return found.withColumn("answer", F.when(F.col("met"), AFFECTED).otherwise(UNREADABLE)).drop("met")


def scan_status(projects: DataFrame, checked: DataFrame, findings: DataFrame,
                project: str = "project") -> DataFrame:
    """Per project: No File, Vulnerable, Error or Secure, and the number of affected findings.

    Error: nothing is known to be affected, but something could not be read.
    """
    answer = F.col("answer") if "answer" in findings.columns else F.lit(AFFECTED)
    tagged = (
        projects.select(project, F.lit(0).alias("f"), F.lit(0).alias("v"), F.lit(0).alias("e"))
        .unionByName(checked.select(project, F.lit(1).alias("f"), F.lit(0).alias("v"), F.lit(0).alias("e")))
        .unionByName(findings.select(project, F.lit(1).alias("f"), (answer == AFFECTED).cast("int").alias("v"),
                                     (answer == UNREADABLE).cast("int").alias("e"))))
    return (tagged.groupBy(project).agg(F.max("f").alias("f"), F.sum("v").alias("n_findings"), F.max("e").alias("e"))
            .select(project, F.when(F.col("f") == 0, "No File").when(F.col("n_findings") > 0, "Vulnerable")
                    .when(F.col("e") > 0, "Error").otherwise("Secure").alias("status"), "n_findings"))
