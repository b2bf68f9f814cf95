"""Sentence boundaries in many languages, in SQL expressions only.

Marks that do not end a sentence (decimals, addresses, initials, abbreviations,
marks inside quotations or brackets) are replaced by private-use placeholders of
the same length, boundaries are then inserted by terminator patterns for the
script at hand, and the original text is cut at the positions found; cutting the
original restores what was masked. No pattern depends on the row's stated language:
the letters of the text decide, and where a text's own lines do not show whether they are wrapped, the widths
of the other texts' lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUT = ""  # inserted after each boundary
DOT = ""  # a mark that never ends a sentence
QUOTED = ""  # a mark inside a quotation
BRACKETED = ""  # a mark inside brackets
OPEN, CLOSE = "", ""  # straight quotation marks by direction
SAID, SPOKEN = "\ue106", "\ue107"  # straight quotation marks by direction
_PRIVATE = CUT + DOT + QUOTED + BRACKETED + OPEN + CLOSE + SAID + SPOKEN

_ENDS = ".!?…。！？｡।॥۔؟"
_D = f"[.{DOT}]"
_BEFORE = r"(?<![\p{L}\p{M}\p{Nd}])"

# Abbreviations that never end a sentence.
_NEVER = (
    "dr|mr|mrs|ms|messrs|prof|rev|gen|col|capt|lt|sgt|sen|rep|gov|hon|st|mt|approx|vs|cf|viz|resp"
    "|hr|fr|bzw|vgl|ca|evtl|ggf|inkl|exkl|zzgl|bspw|sog"
    "|mme|mlle|mgr|réf|sr|sra|srta|dra|pág|págs|núm|ej"
    "|стр|рис|гл|ср|им|ул|проф|тов|табл|डॉ|श्री|कि|ग्रा|मि"
)
# Abbreviations that go on before a number.
_NUMBERED = "no|nos|nr|num|n|p|pp|s|abb|fig|figs|abs|vol|kap|chap|ch|art|ver|tab|tel|ref|eq|sec|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|okt|nov|dec|dez|п|с|т|г|см"
# Abbreviations that can end a sentence; in text without capitals they go on
# unless a word that often opens a sentence follows.
_MAYBE = rf"etc|usw|inc|ltd|co|corp|gmbh|jr|aprox|env|max|min|mins|sec|hrs|uhr|mwst|uu|руб|коп|мин|сек|тыс|млн|[ap]{_D}\s?m|u{_D}\s?s|u{_D}\s?k|t{_D}t{_D}c|т{_D}\s?[дп]"
# Common words that open sentences.
_OPENERS = (
    "the|a|an|i|we|pros|cons|it|this|that|these|my|our|he|she|they|you|there|one|two|five|for|in|on|at|after|when|if|but|so|would|is|are|do|why|what|how|no|yes|not|would|honestly|update|overall|also|works|great"
    "|ich|wir|er|sie|es|der|die|das|ein|eine|mein|meine|nach|am|im|ja|nein|nie|warum|würde|alles|leider|laut|frau|herr"
    "|je|nous|il|elle|le|la|les|un|une|mon|ma|ce|cette|voir|oui|non|jamais|plus|pourquoi"
    "|el|los|las|mi|me|este|esta|por|si|sí|no|nunca|según|ver|compré|recibí"
    "|я|мы|он|она|оно|они|это|этот|эта|вещь|да|нет|почему|после|через|по|в|на|никогда|больше"
)
# Interjections that an ellipsis leads on from.
_INTERJECTIONS = "well|hmm+|um+|uh+|er+m|bueno|pues|bof|euh|ben|na ja|naja|tja|ähm?|ну|эх|гм|うーん|えっと|ええと|まあ|嗯|呃|唔"
_JOINING = "and|or|but|then|y|e|o|pero|et|ou|mais|und|oder|aber|и|а|но|или"
_DOMAINS = "com|org|net|example|info|io|edu|gov|html?|pdf|jpe?g|png"
_MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"


def _r(col: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(col, F.lit("(?U)" + pattern), F.lit(by))


def _inside(col: Column, opening: str, closing: str, by: str, spoken: bool = False) -> Column:
    """Terminators between an opening and a closing mark, however far apart, with no such mark between them.

    The text is cut before every opening and after every closing mark, so each pair is one piece. With
    ``spoken`` openings after a comma or colon are known, and their closing mark becomes SPOKEN.
    """
    opening = opening + SAID if spoken else opening
    whole = rf"(?s)^[{opening}].*[{closing}]$"
    hidden = lambda p: F.translate(p, _ENDS, by * len(_ENDS))
    inner = lambda p: F.when(p.startswith(SAID), F.concat(hidden(F.substr(p, F.lit(1), F.char_length(p) - 1)), F.lit(SPOKEN))).otherwise(hidden(p)) if spoken else hidden(p)
    return F.array_join(F.transform(F.split(col, rf"(?=[{opening}])|(?<=[{closing}])"), lambda p: F.when(p.rlike(whole), inner(p)).otherwise(p)), "")


def mask(df: DataFrame) -> DataFrame:
    """Placeholders in column m for every mark that ends no sentence; the length in code points stays.

    Every conditional step is a projection of its own, so no expression is repeated in the plan.
    """
    t, lower = F.col("m"), F.col("lower")

    def done(expr: Column) -> None:
        nonlocal df
        df = df.withColumn("m", expr)

    t = _r(t, r"(?i)\.(?<=\bwww\.)", DOT)
    # From the start of an address each match goes on where the last one ended.
    t = _r(t, rf"((?i:https?://|\bwww{_D})|\G(?!^))((?:[^\s.]|\.(?![^\s\p{{Lu}}]))*)\.(?=[^\s\p{{Lu}}])", "$1$2" + DOT)
    t = _r(t, rf"\.(?=(?:{_DOMAINS})\b)", DOT)
    t = _r(t, r"[.](?=\p{Nd})(?<=\p{Nd}[.])", DOT)
    done(t)
    t = F.col("m")
    done(F.when(lower, _r(t, r"\.(?=[\p{Ll}\p{Nd}])(?<!\p{Ll}\p{Ll}\.)(?<=\S\.)", DOT)).otherwise(_r(t, r"\.(?=[\p{Ll}\p{Nd}])(?<=[^\s.…]\.)", DOT)))
    t = _r(t, rf"\.(?=\p{{L}}{_D})(?<=(?<![\p{{L}}\p{{M}}])\p{{L}}\.)", DOT)
    t = _r(t, rf"(?i)\.(?!\.)(?<={_BEFORE}(?:{_NEVER})\.)", DOT)
    t = _r(t, rf"(?i)\.(?=\s{{0,2}}\p{{Nd}})(?<={_BEFORE}(?:{_NUMBERED})\.)", DOT)
    t = _r(t, r"(?i)\.(?=\s)(?<=(?<!\p{Nd}\s?)\bсм\.)", DOT)
    t = _r(t, rf"(?i)\.(?<={_BEFORE}(?:e{_D}\s?g|i{_D}\s?e|d{_D}\s?h|z{_D}\s?b|u{_D}\s?a|o{_D}\s?ä|p{_D}\s?ej|т{_D}\s?[ек])\.)", DOT)
    t = _r(t, r"(?i)\.(?=\s+(?:ltd|kg|inc|llc|gmbh)\b)(?<=\bco\.)", DOT)
    t = _r(t, r"(?i)\.(?=\s+uu\b)(?<=\bee\.)", DOT)
    # Initials and one-letter abbreviations, but not a unit after a number.
    t = _r(t, rf"\.(?=\s+\S)(?<=(?<![\p{{L}}\p{{M}}\p{{Nd}}.{DOT}])(?<!\p{{Nd}}\s)(?<!т{_D}\s{{1,2}})\p{{L}}\.)", DOT)
    t = _r(t, r"\.(?<=[฀-๿]\.)", DOT)
    # Ordinals, dates and enumerations.
    t = _r(t, r"(?i)\.(?=\s)(?<=\b(?:am|der|den|dem|vom|zum|des|die|das|im|bis|seit|ab|dieser|jeder)\s{1,2}\p{Nd}{1,2}\.)", DOT)
    t = _r(t, r"\.(?=\s{1,2}\p{Nd}{1,2}\.\s)(?<=\b\p{Nd}{1,2}\.)", DOT)
    t = _r(t, rf"(?i)\.(?=\s+(?:{_MONTHS})\b)(?<=\b\p{{Nd}}{{1,2}}\.)", DOT)
    t = _r(t, rf"\.(?=\s+\p{{Ll}})(?<=\p{{Nd}}{{1,2}}{DOT}\s{{1,2}}\p{{Nd}}{{1,2}}\.)", DOT)
    t = _r(t, r"\.(?=\s)(?<=[:,;]\s{1,2}\p{Nd}{1,2}\.)", DOT)
    t = _r(t, r"(?m)\.(?=\s)(?<=^\s{0,3}\p{Nd}{1,2}\.)", DOT)
    # Ellipses after which the sentence goes on.
    t = _r(t, rf"(?i)(?:\.(?=\.)|(?<=\.)\.|…)(?<={_BEFORE}(?:{_INTERJECTIONS})\s?[.…]{{1,6}})", DOT)
    t = _r(t, r"(\p{L}{2,4})…(?=\1…)", "$1" + DOT)
    t = _r(t, r"…(?=…*(?:算了|不过|但|可是|然后|所以|还是|而已|罢了))", DOT)
    done(t)
    t = F.col("m")
    low = _r(t, rf"(?:\.(?=\.)|(?<=\.)\.|…)(?=[.…]*\s+(?:{_JOINING})\b)", DOT)
    low = _r(low, rf"(?i)\.(?=\s+(?!(?:{_OPENERS})\b)\p{{Ll}})(?<={_BEFORE}(?:{_MAYBE})\.)", DOT)
    done(F.when(lower, low).otherwise(t))
    # Quotations and brackets.
    has = lambda *marks: F.col("m").rlike("[" + "".join(marks) + "]")
    said = lambda x, marks: F.when(lower, _r(x, rf"(?<=[,:]\s{{0,2}})[{marks}]", SAID)).otherwise(x)
    straight = _r(_r(t, r'(?m)(?:(?<=^)|(?<=[\s(（\[—–\-«„“]))"(?=\S)', OPEN), '"', CLOSE)
    for start, end, found in ((OPEN, CLOSE, straight), ("«", "»", t), ("„", "“”", t), ("“", "”", t)):
        here = F.contains(t, F.lit('"' if start == OPEN else start))
        if start == "“":
            here = here & ~F.contains(t, F.lit("„")) & ~F.col("low_quotes")
        if start == "„":
            df = df.withColumn("low_quotes", F.contains(t, F.lit("„")))
        done(F.when(here, said(found, start)).otherwise(t))
        done(F.when(here if start != OPEN else has(OPEN, SAID, CLOSE), _inside(t, start, end, QUOTED, True)).otherwise(t))
    done(F.when(has("「", "『"), _inside(_inside(t, "「", "」", QUOTED), "『", "』", QUOTED)).otherwise(t))
    done(F.when(has("(", "（"), _inside(t, "(（", ")）", BRACKETED)).otherwise(t))
    return df


def usual_widths(df: DataFrame) -> tuple[float, float] | None:
    """(low, high) of the line widths in the texts whose own lines show that they are wrapped; None if none does.

    ``high`` is what nine of ten longest lines do not pass; ``low`` what a line of theirs, with the next word
    added, hardly ever stays under. Two numbers from one aggregate over all texts.
    """
    # A condition inside the aggregate: a filter would be pushed down, and every column above it worked out again.
    own = F.col("some") & F.col("shown")
    row = line_breaks(df, None).agg(F.percentile_approx(F.when(own, F.col("least")), 0.05), F.percentile_approx(F.when(own, F.col("most")), 0.9)).first()
    return None if row[0] is None else (float(row[0]), float(row[1]))


def line_breaks(df: DataFrame, widths: tuple[float, float] | None) -> DataFrame:
    """Adds booleans some, goes_on and tight: signs that text m is wrapped, its single line breaks falling inside sentences.

    A line that ends without a mark before one that starts in lower case is wrapped.
    Failing that (no capitals, scripts without case), the text's own width decides: of at
    least three breaks, 85 % come where the next word would have passed the usual longest
    line, or else where the last word passed the usual shortest one; words of over a third
    of a line say nothing. A text that shows no width of its own, as with one or two breaks,
    is wrapped if its lines keep to the ``widths`` of the other texts.
    Lines and breaks are columns of their own, so that no lambda works them out again per line.
    """
    t = F.col("m")
    broken = t.rlike(r"[\r\n]\s*\S")  # the lines of other texts are not looked at
    df = df.withColumn("lines", F.when(broken, F.transform(F.split(t, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))))
    pairs = F.zip_with(F.slice("lines", 1, F.size("lines") - 1), F.slice("lines", 2, F.size("lines")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    df = df.withColumn("breaks", F.filter(pairs, lambda x: (F.char_length(x["a"]) > 0) & (F.char_length(x["b"]) > 0)))
    df = df.withColumn("loose", F.filter("breaks", lambda x: ~x["a"].rlike(rf"(?U)[{_ENDS}][\p{{Pe}}\p{{Pf}}\p{{Pi}}\"'’]*$")))
    word = lambda c, p: F.char_length(F.regexp_extract(c, p, 0))
    df = df.withColumn("ends", F.transform("breaks", lambda x: F.struct(F.char_length(x["a"]).alias("n"), word(x["b"], r"(?U)^\S+").alias("next"), word(x["a"], r"(?U)\S+$").alias("last"))))
    df = df.withColumn("widths", F.array_sort(F.transform("ends", lambda x: x["n"])))
    rank = F.size("widths") - 1
    df = df.withColumns({"longest": F.get("widths", F.floor((9 * rank + 9) / 10).cast("int")), "shortest": F.get("widths", F.floor(rank / 10).cast("int"))})
    most = lambda f: F.size(F.filter("ends", f)) >= 0.85 * F.size("ends")
    filled = most(lambda x: (x["n"] + 1 + x["next"] > F.col("longest")) & (3 * x["next"] <= F.col("longest")))
    passed = most(lambda x: (x["n"] - x["last"] - 1 < F.col("shortest")) & (x["n"] >= F.col("shortest")) & (3 * x["last"] <= F.col("shortest")))
    shown = (F.size("ends") >= 3) & (filled | passed)
    df = df.withColumns({"most": F.array_max(F.transform("lines", lambda x: F.char_length(x))), "least": F.array_min(F.transform("ends", lambda x: x["n"] + 1 + x["next"]))})
    tight = shown if widths is None else shown | ((F.col("most") <= widths[1]) & (F.col("least") >= widths[0]))
    goes_on = F.exists("loose", lambda x: x["b"].rlike(r"^[\p{Ll},;:!?)»]"))
    some = (F.size("loose") > 0) & ~t.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]{4}")
    said = {k: F.coalesce(v, F.lit(False)) for k, v in {"some": some, "goes_on": goes_on, "tight": tight, "shown": shown}.items()}
    return df.withColumns(said).drop("lines", "breaks", "loose", "ends", "widths", "longest", "shortest")


def split_points(df: DataFrame) -> DataFrame:
    """Adds column m: the masked text of column t with CUT after each sentence; without CUT it is as long as t."""
    df = df.withColumn("m", F.translate("t", _PRIVATE, "�" * len(_PRIVATE)))
    widths = usual_widths(df.select("m"))
    t = F.col("m")
    n = lambda p: F.regexp_count(t, F.lit(p))
    only = lambda c, p: F.char_length(F.regexp_replace(c, F.lit(p), F.lit("")))
    df = line_breaks(df, widths)
    df = df.withColumns({"letters": only(t, r"\P{L}+"), "cased": only(t, r"[^\p{Lu}\p{Ll}]+"), "uppers": n(r"\p{Lu}"), "after_low": n(r"[.!?]\s+\p{Ll}"), "after_up": n(r"[.!?]\s+\p{Lu}")})
    df = df.withColumn("bicameral", F.col("cased") * 2 > F.col("letters"))
    df = df.withColumn("lower", F.col("bicameral") & ((F.col("uppers") == 0) | ((F.col("after_low") > F.col("after_up")) & (F.col("uppers") * 60 < F.col("cased")))))
    df = df.withColumn("plain", F.col("bicameral") & ~F.col("lower"))
    df = df.withColumn("wrapped", F.col("some") & F.when(F.col("plain"), F.col("goes_on") | F.col("tight")).otherwise(F.col("tight")))
    df = mask(df)
    m, plain, lower, bicameral = F.col("m"), F.col("plain"), F.col("lower"), F.col("bicameral")

    def done(expr: Column) -> None:
        nonlocal df
        df = df.withColumn("m", expr)

    # Brackets and quotations that hold the end of their sentence.
    stop = r"\s,;:.!?。！？…"
    done(F.when(plain, _r(m, rf"({BRACKETED}[)）])(?=\s*[^{stop}\p{{Ll}}])", "$1" + CUT)).otherwise(_r(m, rf"({BRACKETED}[)）])(?=\s*[^{stop}])", "$1" + CUT)))
    shut = f"{CLOSE}{SPOKEN}»”“’"
    done(
        F.when(plain, _r(m, rf"({QUOTED}[{shut}]+)(?=\s+[\p{{Lu}}\p{{Nd}}¿¡«„“{OPEN}(（])", "$1" + CUT))
        .when(lower, _r(m, rf"({QUOTED}{SPOKEN})(?=\s+\S)", "$1" + CUT))
        .otherwise(m)
    )
    # Terminators of scripts that need no space after them.
    x = _r(m, r"([。！？｡]+[!?]*[」』）”’]*)", "$1" + CUT)
    x = _r(x, r"(…+)(?=[^\s，、。！？…」』”])(?<=[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー）」”]…{1,9})", "$1" + CUT)
    x = _r(x, r"([।॥۔؟]+[!?]*)", "$1" + CUT)
    done(_r(x, r"(?:(?<=ครับ)|(?<=ค่ะ)|(?<=คะ)|(?<=จ้ะ)|(?<=จ้า))(\s+)(?=\S)", CUT + "$1"))
    # Full stops, question and exclamation marks before a space.
    after = r"\s,;:—–\-.!?…)»”"
    ends = rf"([.!?…]+[{CLOSE}{SPOKEN}»”’)\]]*)"
    done(F.when(plain, _r(m, rf"{ends}(?=\s+[^\p{{Ll}}{after}])", "$1" + CUT)).otherwise(_r(m, rf"{ends}(?=\s+[^{after}])", "$1" + CUT)))
    # The space after a mark left out.
    done(_r(m, rf"([.!?…])(?=[\p{{Lu}}¿¡«„“])(?<=(?:\p{{Ll}}\p{{Ll}}|\p{{Nd}}|[)»”{CLOSE}{SPOKEN}]|\s|[ap]{_D}m|\p{{Lu}}{_D}\p{{Lu}}|[.!?…])[.!?…])", "$1" + CUT))
    tight_low = _r(_r(m, r"([!?])(?=\p{Ll})", "$1" + CUT), r"(\.)(?=\p{Ll}\p{Ll})(?<=\p{Ll}\p{Ll}\.)", "$1" + CUT)
    done(F.when(lower, tight_low).when(~bicameral, _r(m, r"([!?])(?=[\p{L}¿¡«„“])", "$1" + CUT)).otherwise(m))
    # Lines.
    done(F.when(F.col("wrapped"), _r(m, r"((?:\r\n|\r|\n)\s*(?:\r\n|\r|\n))", "$1" + CUT)).otherwise(_r(m, r"(\r\n|\r|\n)", "$1" + CUT)))
    return df


def sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentence, start_pos, end_pos, text): one row per sentence of every non-blank text.

    Positions count code points; end_pos is the number of them through the sentence's
    last non-space character. Null and blank texts give no row, a text without any mark
    is one sentence, repeated rows repeat their sentences; whole texts of any length are
    cut; other columns are dropped.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("t")).filter(F.col("t").rlike(r"(?U)\S"))
    rows = split_points(rows).select("id", "t", "m")
    sizes = F.transform(F.split("m", CUT), lambda p: F.struct(F.char_length(p).alias("n"), F.char_length(F.regexp_replace(p, r"(?U)\s+$", "")).alias("used"), F.char_length(F.regexp_replace(p, r"(?U)^\s+", "")).alias("rest")))
    step = lambda acc, x: F.struct((acc["at"] + x["n"]).alias("at"), F.when(x["used"] > 0, F.array_append(acc["out"], F.struct((acc["at"] + x["n"] - x["rest"]).alias("s"), (acc["at"] + x["used"]).alias("e")))).otherwise(acc["out"]).alias("out"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    found = F.aggregate(sizes, zero, step, lambda acc: acc["out"])
    cut = rows.select("id", "t", F.posexplode(found).alias("i", "p"))
    return cut.select("id", (F.col("i") + 1).alias("sentence"), F.col("p.s").alias("start_pos"), F.col("p.e").alias("end_pos"), F.substring(F.col("t"), F.col("p.s") + 1, F.col("p.e") - F.col("p.s")).alias("text"))
