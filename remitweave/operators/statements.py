"""Bank statements: MT940, OFX, CAMT.053 and dated text rows, and the proof that one adds up.

A statement is a file, read whole by one task as it must balance as a whole; files are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from remitweave.sources.shared import written


def detect(content: Column) -> Column:
    """Format by the first characters; content is text."""
    head = F.substring(F.ltrim(content), 1, 400)
    return (
        F.when(head.startswith("%PDF"), "pdf")
        .when(head.contains("camt.053") | head.contains("BkToCstmrStmt"), "camt053")
        .when(head.contains("<OFX>") | head.startswith("OFXHEADER"), "ofx")
        .when(head.rlike("(?s):20:.*:25:|(?s):25:.*:60[FM]:"), "mt940")
        .otherwise("text")
    )


def cents(amount: Column, decimal: str = ".") -> Column:
    plain = F.regexp_replace(amount, "[^0-9,.-]", "")
    plain = F.regexp_replace(plain, ",", ".") if decimal == "," else F.regexp_replace(plain, ",", "")
    return (F.round(plain.try_cast("decimal(24,4)"), 2) * 100).try_cast("bigint")


def _rows(files: DataFrame, pieces: Column) -> DataFrame:
    return files.select("file", "content", F.posexplode(pieces).alias("line", "piece")).withColumn("line", F.col("line") + 1)


def mt940(files: DataFrame) -> DataFrame:
    """file, line, day, amount_cents (signed), reference, narration, opening_cents, closing_cents."""
    balance = lambda tag: F.when(F.regexp_extract("content", tag, 1) == "D", -1).otherwise(1) * cents(F.regexp_extract("content", tag, 2), ",")
    opening, closing = balance(r":60[FM]:([CD])\d{6}[A-Z]{3}([\d,]+)"), balance(r":62[FM]:([CD])\d{6}[A-Z]{3}([\d,]+)")
    pieces = F.regexp_extract_all("content", F.lit(r"(?s):61:.*?(?=:61:|:62[FM]:|\z)"), F.lit(0))
    head = r"^:61:(\d{6})(?:\d{4})?(RC|RD|C|D)[A-Z]?([\d,]+)[A-Z][A-Z0-9]{3}([^\n]*)"
    mark = F.regexp_extract("piece", head, 2)
    sign = F.when(mark.isin("C", "RD"), 1).otherwise(-1)
    return _rows(files.withColumn("opening_cents", opening).withColumn("closing_cents", closing).withColumn("content", F.col("content")), pieces).join(
        files.select("file", opening.alias("opening_cents"), closing.alias("closing_cents")), "file"
    ).select(
        "file", "line", F.try_to_date(F.regexp_extract("piece", head, 1), "yyMMdd").alias("day"), (sign * cents(F.regexp_extract("piece", head, 3), ",")).alias("amount_cents"),
        F.trim(F.regexp_extract("piece", head, 4)).alias("reference"), F.trim(F.regexp_replace(F.regexp_extract("piece", r"(?s):86:(.*)$", 1), r"\s+", " ")).alias("narration"), "opening_cents", "closing_cents",
    )


def ofx(files: DataFrame) -> DataFrame:
    """As mt940; the opening balance follows from the closing one."""
    tag = lambda name: F.trim(F.regexp_extract("piece", f"<{name}>([^<\r\n]*)", 1))
    pieces = F.regexp_extract_all("content", F.lit("(?s)<STMTTRN>.*?(?=</STMTTRN>|<STMTTRN>|</BANKTRANLIST>)"), F.lit(0))
    closing = cents(F.regexp_extract("content", r"(?s)<LEDGERBAL>.*?<BALAMT>([^<\r\n]*)", 1))
    rows = _rows(files, pieces).select(
        "file", "line", F.try_to_date(F.substring(tag("DTPOSTED"), 1, 8), "yyyyMMdd").alias("day"), cents(tag("TRNAMT")).alias("amount_cents"), tag("FITID").alias("reference"),
        F.trim(F.concat_ws(" ", tag("NAME"), tag("MEMO"))).alias("narration"), closing.alias("closing_cents"),
    )
    total = F.sum("amount_cents").over(Window.partitionBy("file"))
    return rows.withColumn("opening_cents", F.col("closing_cents") - total)


def camt053(files: DataFrame) -> DataFrame:
    """As mt940; booked entries only."""
    inside = lambda text, path: F.regexp_extract(text, path, 1)
    balance = lambda code: F.when(inside(F.col("content"), rf"(?s)<Cd>(?:{code})</Cd>.*?<CdtDbtInd>(\w+)") == "DBIT", -1).otherwise(1) * cents(inside(F.col("content"), rf"(?s)<Cd>(?:{code})</Cd>.*?<Amt[^>]*>([\d.]+)<"))
    pieces = F.regexp_extract_all("content", F.lit("(?s)<Ntry>.*?</Ntry>"), F.lit(0))
    piece = F.col("piece")
    return (
        _rows(files, pieces)
        .filter(inside(piece, "(?s)<Sts>(?:\\s*<Cd>)?(\\w+)") == "BOOK")
        .select(
            "file", "line", F.try_to_date(inside(piece, r"(?s)<BookgDt>.*?(\d{4}-\d{2}-\d{2})"), "yyyy-MM-dd").alias("day"),
            (F.when(inside(piece, r"<CdtDbtInd>(\w+)") == "DBIT", -1).otherwise(1) * cents(inside(piece, r"<Amt[^>]*>([\d.]+)<"))).alias("amount_cents"),
            inside(piece, "<EndToEndId>([^<]*)").alias("reference"), inside(piece, "<Ustrd>([^<]*)").alias("narration"),
            balance("OPBD|PRCD").alias("opening_cents"), balance("CLBD").alias("closing_cents"),
        )
    )


def text_rows(files: DataFrame) -> DataFrame:
    """Dated rows of amount and running balance; a row's sign is the one that leads from balance to balance."""
    row = r"^(\d{2}/\d{2}/\d{4})\s+(.*?)\s+([\d,]+\.\d{2})\s+([\d,]+\.\d{2})$"
    opening = cents(F.regexp_extract("content", r"(?im)^opening balance\s+([\d,]+\.\d{2})", 1))
    closing = cents(F.regexp_extract("content", r"(?im)^closing balance\s+([\d,]+\.\d{2})", 1))
    rows = _rows(files, F.filter(F.split("content", "\r?\n"), lambda x: F.trim(x).rlike(row))).select(
        "file", "line", F.try_to_date(F.regexp_extract(F.trim("piece"), row, 1), "dd/MM/yyyy").alias("day"), F.regexp_extract(F.trim("piece"), row, 2).alias("narration"),
        cents(F.regexp_extract(F.trim("piece"), row, 3)).alias("moved"), cents(F.regexp_extract(F.trim("piece"), row, 4)).alias("balance_cents"), opening.alias("opening_cents"), closing.alias("closing_cents"),
    )
    before = F.coalesce(F.lag("balance_cents").over(Window.partitionBy("file").orderBy("line")), F.col("opening_cents"))
    sign = F.when(before + F.col("moved") == F.col("balance_cents"), 1).when(before - F.col("moved") == F.col("balance_cents"), -1)
    return rows.withColumn("amount_cents", sign * F.col("moved")).withColumn("reference", F.lit("")).drop("moved")


def verify(lines: DataFrame) -> DataFrame:
    """Per file: opening + credits - debits = closing, every running balance (where there is one), dates in order."""
    order = Window.partitionBy("file").orderBy("line")
    running = F.col("opening_cents") + F.sum("amount_cents").over(order.rowsBetween(Window.unboundedPreceding, 0))
    stated = F.col("balance_cents") if "balance_cents" in lines.columns else F.lit(None).cast("bigint")
    rows = lines.withColumn("bad", F.col("amount_cents").isNull() | F.coalesce(running != stated, F.lit(False))).withColumn("late", F.coalesce(F.lag("day").over(order) > F.col("day"), F.lit(False)))
    out = rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.greatest("amount_cents", F.lit(0))).alias("credits_cents"), F.sum(F.greatest(-F.col("amount_cents"), F.lit(0))).alias("debits_cents"),
        F.first("opening_cents").alias("opening_cents"), F.first("closing_cents").alias("closing_cents"), F.min(F.when(F.col("bad"), F.col("line"))).alias("first_bad_line"), F.max("late").alias("out_of_order"),
    )
    adds = F.col("opening_cents") + F.col("credits_cents") - F.col("debits_cents") == F.col("closing_cents")
    return out.withColumn("balances", F.coalesce(adds & F.col("first_bad_line").isNull(), F.lit(False)))


#: What every parser gives; a balance of each line is known of text only.
LINE = ("file", "line", "day", "amount_cents", "reference", "narration", "opening_cents", "closing_cents", "balance_cents")
#: Files that hold no text, and why they are refused.
UNREAD = {"pdf": "a PDF", "image": "a picture"}


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All statements below ``path``, whatever their kinds: their lines (``LINE``, and kind), and one row per file with kind, n, what ``verify`` finds, holds, and
    why it is refused (null if it holds). Each file goes to the parser that its content asks for; its lines are read once and written, as proof and use both need them."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.hex(F.substring("content", 1, 4)).alias("_first"))
    picture = F.col("_first").isin("89504E47") | F.col("_first").startswith("FFD8FF")
    files = raw.withColumn("kind", F.when(picture, "image").otherwise(detect(F.col("content")))).drop("_first")
    parts = []
    for kind, parser in {"mt940": mt940, "ofx": ofx, "camt053": camt053, "text": text_rows}.items():
        rows = parser(files.filter(F.col("kind") == kind))
        parts.append(rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("bigint").alias(c) for c in LINE], F.lit(kind).alias("kind")))
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    lines = written(lines)
    proof = files.select("file", "kind").join(verify(lines), "file", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    holds = F.coalesce("balances", F.lit(False))
    why = F.lit(None).cast("string")
    for kind, reason in UNREAD.items():
        why = F.when(F.col("kind") == kind, reason).otherwise(why)
    refused = F.coalesce(why, F.when(F.col("n") == 0, "no lines").when(F.col("opening_cents").isNull() | F.col("closing_cents").isNull(), "states no balance").when(~holds, "does not balance"))
    return lines, proof.withColumn("holds", holds & refused.isNull()).withColumn("refused", refused).drop("balances")


def credits(lines: DataFrame, proof: DataFrame) -> DataFrame:
    """Credits of the files that balance, as feed rows; repeated references get a suffix of their place."""
    rows = lines.join(proof.filter("balances").select("file"), "file", "left_semi").filter("amount_cents > 0")
    again = F.row_number().over(Window.partitionBy("file", "reference").orderBy("line"))
    name = F.when(F.col("reference") == "", F.concat_ws("-", F.lit("LINE"), "line")).otherwise(F.col("reference"))
    return rows.withColumn("_n", again).select("file", F.when((F.col("_n") > 1) & (F.col("reference") != ""), F.concat_ws("-", name, "line")).otherwise(name).alias("txn_id"), "day", "amount_cents", "narration")
