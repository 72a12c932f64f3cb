"""Texts that were cut off: incomplete endings, the lengths at which a feed cuts, and feeds whose transfers break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.labels import plain
from corpusloom.plans.lineage import materialize

#: What may be trimmed from a text's end.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  　"
#: Characters from the end that the patterns below can reach: none looks back further than 300.
REACH = 600
# Lines of page furniture below a text, whole or cut: rules, page numbers.
FOOT = r"(?:\n+[ \t]*(?:[ \t\d*_=~–—-]{1,40}|(?:[Pp]age|PAGE|Seite|Página|página) \d+(?: (?:of|von|de|sur) \d+)?)[ \t]*)+$"
# Marks that a cut leaves: an ellipsis, the start of an escape, a replacement character.
MARK = r"(?:…|\.\.\.|\\(?:u[0-9a-fA-F]{0,4}|x[0-9a-fA-F]?)?|%(?:[0-9A-F]{2}%)*[0-9A-F]|&(?:#[0-9xX]?[0-9a-fA-F]*|[A-Za-z]{1,6})?|�)$"
# A number broken at its point, an ordinal before its month.
BROKEN = r"(?:[$€£] ?\d{1,3}|\b(?:am|zum|vom|dem|ab|bis) \d{1,2})\.$"
# A numbered heading without its clause, or a stop that may be an abbreviation's.
DOUBTFUL = r"(?:(?:^|\n)\s*\d+(?:\.\d+)+ \p{Lu}[\w ]{2,40}|\b(?:Inc|Ltd|Co|No|Nos|Art|Nr|Abs|Ziff|[A-Z]\.[A-Z]))\.$"
# A sentence's stop, with what closes behind it, or a closing bracket or quotation mark.
STOP = r"[.!?;。؟।][\p{Pe}\p{Pf}\"']*$|[\p{Pe}\p{Pf}]$"
# A last line that is no sentence: a word and its number, a field with its name, a row of columns, capitals.
LINE = r"(?:^|\n)\s*(?:\p{Lu}[\p{L}.]* \d+\b[^\n]{0,90}|\p{Lu}[\p{L} ]{0,20}:[^\n]{0,60}|[^\n]{0,80}\S {2,}[^\n]{0,40}\d[^\n]{0,12}|\P{Ll}{0,60}\p{Lu}{3,}[^\p{Ll}\n]{0,40})$"

WHOLE, DOUBT, OPEN = 0, 1, 2


def ending(text: Column) -> Column:
    """How a text ends: OPEN inside a word, number or sentence; DOUBT where only the length can tell; else WHOLE.

    Null, empty and blank texts and texts of page furniture alone are whole.
    """
    end = F.rtrim(F.regexp_replace(F.substring(F.rtrim(text, F.lit(BLANKS)), -REACH, REACH), FOOT, ""), F.lit(BLANKS))
    e = F.col("_end")
    state = (
        F.when(e.isNull() | (e == ""), WHOLE)
        .when(e.rlike(MARK) | e.rlike(BROKEN), OPEN)
        .when(e.rlike(DOUBTFUL), DOUBT)
        .when(e.rlike(STOP) | e.rlike(LINE), WHOLE)
        .otherwise(OPEN)
    )
    return end, state


def _tail(k: Column, expected: Column) -> Column:
    """Chernoff's bound on the chance that a Poisson count of the given expectation reaches k."""
    k = k.cast("double")
    return F.when(k > expected, F.exp(-(k * F.log(k / expected) - k + expected))).otherwise(1.0)


class Truncation:
    """Cut texts, the lengths at which feeds cut, and how often they do.

    A feed's hazard at a length is the share of its texts that end there among
    those at least as long, counted in characters and in bytes of UTF-8; equal
    texts of a feed count once, so that a text delivered often is no limit.
    Each hazard is tested against that of its neighbours (``near`` lengths on
    either side, itself left out) with a Chernoff bound on the Poisson tail, and
    the false discovery rate over all lengths of all feeds is held at ``fdr`` by
    the rule of Benjamini and Hochberg.  Incomplete endings at significant
    lengths are cut, doubtful ones too.

    A transfer that breaks cuts anywhere.  So the hazard of an incomplete ending
    at other lengths is tested for each feed, by the same bound and rule,
    against the share ``noise`` of texts that look incomplete without a cut;
    incomplete endings of significant feeds are cut as well (see transfers).  A whole ending is
    never a case, however many texts share its length, and no ending of a feed
    without significant hazards is.

    Null, empty and blank texts are never cut.  A null source is a feed of its
    own; repeated keys are separate rows.
    """

    def __init__(self, df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", near: int = 25, fdr: float = 0.01, noise: float = 0.002):
        self.key, self.near, self.fdr, self.noise = key, near, fdr, noise
        t = F.col("_text")
        end, state = ending(t)
        rows = df.select(F.col(key).alias("key"), plain(F.col(source)).alias("feed"), F.col(text).alias("_text")).withColumn("_end", end)
        self.rows = materialize(
            rows.select(
                "key", "feed", F.coalesce(F.length(t), F.lit(0)).alias("chars"), F.coalesce(F.octet_length(t), F.lit(0)).alias("bytes"), F.xxhash64(t).alias("h"), state.cast("tinyint").alias("state")
            ),
            "endings",
        )
        once = self.rows.where("chars > 0").groupBy(F.coalesce("feed", F.lit("")).alias("feed"), "chars", "bytes", "h").agg(F.max("state").alias("state"))
        self.texts = materialize(once, "texts")
        self._hazards: DataFrame | None = None

    def hazards(self) -> DataFrame:
        """(feed, unit, length, ended, at_risk, expected, p, significant), for lengths with at least one text.

        At most ``longest text`` lengths a feed and unit have a row, so windows
        run over this table and never over the documents.
        """
        if self._hazards is not None:
            return self._hazards
        unit = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
        counts = self.texts.select("feed", unit.alias("x")).groupBy("feed", "x.unit", "x.length").agg(F.count(F.lit(1)).alias("ended"))
        by = Window.partitionBy("feed", "unit").orderBy("length")
        around = by.rangeBetween(-self.near, self.near)
        onward = by.rangeBetween(0, Window.unboundedFollowing)
        beyond = by.rangeBetween(self.near + 1, Window.unboundedFollowing)
        # texts at risk at all lengths of the window: one that ends at L is so from the first of them (1 at least) to L
        first, last = F.greatest(F.col("length") - self.near, F.lit(1)), F.col("length") + self.near
        inside = F.sum(F.col("ended") * F.col("length")).over(around) + (1 - first) * F.sum("ended").over(around)
        at_risk = F.sum("ended").over(onward)
        exposed = inside + F.coalesce(F.sum("ended").over(beyond), F.lit(0)) * (last - first + 1) - at_risk
        h = counts.withColumns({"at_risk": at_risk, "others": F.sum("ended").over(around) - F.col("ended"), "exposed": exposed})
        # half a text more than was seen keeps empty neighbourhoods from proving anything; no more can end than are at risk
        expected = F.col("at_risk") * F.when(F.col("exposed") > 0, F.least((F.col("others") + 0.5) / F.col("exposed"), F.lit(1.0))).otherwise(1.0)
        h = h.withColumn("expected", expected).withColumn("p", _tail(F.col("ended"), F.col("expected"))).drop("others", "exposed")
        self._hazards = materialize(self._discovered(materialize(h, "lengths")), "hazards")
        return self._hazards

    def _discovered(self, h: DataFrame) -> DataFrame:
        """Benjamini-Hochberg over the p-values of all rows: the largest p that is under fdr * rank / tests is the cut.

        The tests are (feed, length) pairs, not documents; only those with
        p <= fdr, which alone can be under the line, are ranked.
        """
        tests = h.agg(F.count(F.lit(1)).alias("tests"))
        able = h.where(F.col("p") <= self.fdr).groupBy("p").agg(F.count(F.lit(1)).alias("here"))
        ranked = able.withColumn("rank", F.sum("here").over(Window.orderBy("p"))).crossJoin(F.broadcast(tests))
        cut = ranked.where(F.col("p") <= F.lit(self.fdr) * F.col("rank") / F.col("tests")).agg(F.coalesce(F.max("p"), F.lit(-1.0)).alias("cut"))
        return h.crossJoin(F.broadcast(cut)).withColumn("significant", F.col("p") <= F.col("cut")).drop("cut")

    def _at_limits(self, rows: DataFrame) -> DataFrame:
        """rows (feed not null) with at_limit: whether the length in characters or bytes is significant for the feed."""
        found = self.hazards().where("significant")
        c = found.where("unit = 'chars'").select("feed", F.col("length").alias("chars"), F.lit(True).alias("at_c"))
        b = found.where("unit = 'bytes'").select("feed", F.col("length").alias("bytes"), F.lit(True).alias("at_b"))
        return rows.join(c, ["feed", "chars"], "left").join(b, ["feed", "bytes"], "left").withColumn("at_limit", F.coalesce("at_c", "at_b", F.lit(False))).drop("at_c", "at_b")

    def transfers(self) -> DataFrame:
        """(feed, texts, open, expected, p, significant): incomplete endings of each feed at no significant length.

        Feeds that show nothing by themselves, as small ones cannot, are tested
        once more as one: significant together, all of them count.
        """
        off = self._at_limits(self.texts).where("not at_limit").groupBy("feed").agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("state") == OPEN).alias("open"))
        h = off.withColumn("expected", F.col("texts") * F.lit(self.noise)).withColumn("p", _tail(F.col("open"), F.col("expected")))
        h = materialize(self._discovered(materialize(h, "feeds")), "feeds")
        rest = h.where("not significant").agg(F.sum("open").alias("k"), F.sum("expected").alias("e"))
        together = rest.select((_tail(F.col("k"), F.col("e")) <= self.fdr).alias("_all"))
        return h.crossJoin(F.broadcast(together)).withColumn("significant", F.col("significant") | F.coalesce("_all", F.lit(False))).drop("_all")

    def flagged(self) -> DataFrame:
        """(key, feed, chars, state, at_limit, broken, cut) of every row; broken: the feed's transfers break."""
        rows = self._at_limits(self.rows.withColumn("_null", F.col("feed").isNull()).withColumn("feed", F.coalesce("feed", F.lit(""))))
        bad = materialize(self.transfers().where("significant").select("feed", F.lit(True).alias("broken")), "transfers")
        out = rows.join(F.broadcast(bad), "feed", "left").withColumn("broken", F.coalesce("broken", F.lit(False)))
        cut = F.when(F.col("at_limit"), F.col("state") > WHOLE).otherwise(F.col("broken") & (F.col("state") == OPEN))
        return out.select(F.col("key").alias(self.key), F.when(~F.col("_null"), F.col("feed")).alias("feed"), "chars", "state", "at_limit", "broken", cut.alias("cut"))

    def report(self) -> DataFrame:
        """(source, docs, cut, cut_at_limit, cut_share) by feed."""
        n = self.flagged().groupBy(F.col("feed").alias("source")).agg(F.count(F.lit(1)).alias("docs"), F.count_if("cut").alias("cut"), F.count_if(F.col("cut") & F.col("at_limit")).alias("cut_at_limit"))
        return n.withColumn("cut_share", F.round(F.col("cut") / F.col("docs"), 6))
