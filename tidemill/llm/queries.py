"""Queries pN_... of the problems on text, over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import encode, lookalike, mixture
from tidemill.session import materialize
from tidemill.sources.tables import load


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode(load(spark, sf, "documents").select("doc_id", "text"), ["doc_id"])


def p8_tokens_by_source(spark: SparkSession, sf: str) -> DataFrame:
    sized = encode.token_counts(load(spark, sf, "documents").select("doc_id", "source", "text"), ["doc_id", "source"])
    return sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"))


def _mixture(spark: SparkSession, sf: str) -> mixture.Mixture:
    return mixture.mix(load(spark, sf, "documents").select("doc_id", "source", "text"), load(spark, sf, "mix_targets"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf).records


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.shares_reached(_mixture(spark, sf))


def p9_filled_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of a mixture as large as its sources, in which the small ones are used up to their caps."""
    documents = load(spark, sf, "documents").select("doc_id", "source", "text")
    return mixture.shares_reached(mixture.mix(documents, load(spark, sf, "mix_targets"), fill=True))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.pairs(materialize(lookalike.digests(load(spark, sf, "documents").select("doc_id", "text"))))


def p10_classes(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.classes(materialize(lookalike.digests(load(spark, sf, "documents").select("doc_id", "text"))))


def p10_forms(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.forms(load(spark, sf, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (p8_ids, p8_tokens_by_source, p9_mix, p9_shares, p9_filled_shares, p10_found, p10_classes, p10_forms)}


#: The mapping for SQL, stated apart from the operator's tables: letters that occur disguised, full-width and half-width forms.
_LIKE = ("аеосрѕіухԁһјгАВЕІКМНОРСТУХοΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeocpsiyxdhjrABEIKMHOPCTYXoABEZHIKMNOPTYX")
_KANA = ("ｰﾀｳｶﾝﾊﾃｷｻｭﾛｸｴﾗﾒｾｽﾄｯｼﾞﾟｱｲｵｹｺｿﾁﾂﾅﾆﾇﾈﾉﾋﾌﾍﾎﾏﾐﾑﾓﾔﾕﾖﾘﾙﾚﾜｦｬｮ", "ータウカンハテキサュロクエラメセストッシ\u3099\u309aアイオケコソチツナニヌネノヒフヘホマミムモヤユヨリルレワヲャョ")
_WIDE = ("".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))))
_SPACES = ("\u00a0\u2007\u202f\u3000", "    ")


def _translated(text: str) -> str:
    old, new = ("".join(x[i] for x in (_LIKE, _KANA, _WIDE, _SPACES)).replace("'", "''") for i in (0, 1))
    return f"translate({text}, '{old}', '{new}')"


_LINES = "replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_BARE = f"regexp_replace(nfc_normalize({_LINES}), '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}\\x{{FEFF}}\\x{{FE00}}-\\x{{FE0F}}]', '', 'g')"
#: What is seen, for the characters of the test tables: no letter of the mapping bears a mark there but io.
_SEEN = "nfc_normalize(" + _translated(f"replace(replace(nfc_normalize({_BARE}), 'ё', 'ë'), 'Ё', 'Ë')") + ")"
_FORM = f"regexp_replace(replace(replace(lower({_SEEN}), 'ß', 'ss'), 'ς', 'σ'), '[\\x{{09}}-\\x{{0D}}\\x{{1C}}-\\x{{1F}}\\x{{85}}\\x{{2028}}\\x{{2029}}]', ' ', 'g')"

ORACLE = {
    "p10_found": f"""WITH v AS (SELECT doc_id, text, md5({_SEEN}) AS seen FROM documents WHERE text != '')
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM v a JOIN v b ON a.seen = b.seen AND a.doc_id < b.doc_id AND a.text != b.text""",
    "p10_classes": f"""WITH v AS (SELECT doc_id, md5(text) AS content, md5({_SEEN}) AS seen FROM documents WHERE text != ''),
c AS (SELECT seen, min(doc_id) AS class_id, count(*) AS n_documents, count(DISTINCT content) AS n_contents FROM v GROUP BY seen)
SELECT doc_id, class_id, n_documents, n_contents FROM v JOIN c USING (seen)""",
    "p10_forms": f"WITH f AS (SELECT doc_id, text, {_FORM} AS form FROM documents) SELECT doc_id, form, form != text AS changed FROM f",
}
