"""Files -> scannable files -> comment-free text -> tokens."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.comments import strip_comments
from ..functions.entropy import has_nul, is_high_entropy
from ..functions.paths import is_scannable_file
from ..functions.urls import is_noise_url
from ..schemas import RELEASE
from ..session import materialize
from .split_hooks import TAIL, hooks_and_tail, is_tail, join_split_hooks


def scannable_files(files: DataFrame) -> DataFrame:
    return files.where(is_scannable_file(F.col("path")))


def strip_files(files: DataFrame) -> DataFrame:
    """Replace ``content`` by its comment-free text."""
    return files.withColumn("content", strip_comments(F.col("path"), F.col("content")))


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tokens_in(text: Column, kind: str) -> Column:
    """All tokens of one kind in order of appearance.

    Risky words are kept once per text: only their first appearance counts.
    """
    if kind == "url":
        return _matches(text, P.URL_TOKEN)
    if kind == "import":
        return F.array_distinct(_matches(text, P.RISKY_WORD_TOKEN))
    if kind == "literal":
        return _matches(text, P.LITERAL_TOKEN)
    if kind == "hook":
        return _matches(text, P.HOOK_TOKEN)
    raise ValueError(f"unknown token kind {kind!r}")


def tokens_by_kind(text: Column, kinds: tuple[str, ...] = tuple(P.SIGNALS), tails: bool = False) -> list[Column]:
    """(kind, found) of every kind; with ``tails`` the hooks end with the one the text breaks off."""
    found = {k: hooks_and_tail(text) if tails and k == "hook" else tokens_in(text, k) for k in kinds}
    return [F.struct(F.lit(k).alias("kind"), f.alias("found")) for k, f in found.items()]


def kind_of(kind: Column, token: Column) -> Column:
    """The kind of a token cut with ``tails``."""
    return F.when((kind == "hook") & is_tail(token), TAIL).otherwise(kind)


def extract_tokens(
    files: DataFrame, kinds: tuple[str, ...] = tuple(P.SIGNALS), text: str = "content", tails: bool = False
) -> DataFrame:
    """One row per token; the text is read once and dropped right after extraction.

    ``pos`` orders the tokens of one kind within a file.  With ``tails`` a hook that the end of
    a file breaks off is a row of kind 'tail'.
    """
    rest = [c for c in files.columns if c != text]
    kind = F.col("_k.kind")
    cut = (
        files.select(*rest, F.explode(F.array(*tokens_by_kind(F.col(text), kinds, tails))).alias("_k"))
        .select(*rest, kind.alias("kind"), F.posexplode("_k.found").alias("pos", "token"))
    )
    return cut.withColumn("kind", kind_of(F.col("kind"), F.col("token"))) if tails else cut


def may_signal(kind: Column, token: Column) -> Column:
    """False for tokens that can never become evidence, whatever the other release holds.

    Decided on the token alone, so both sides of the comparison can be cut down
    before they are shuffled.
    """
    return (
        F.when(kind == "url", ~is_noise_url(token))
        .when(kind == "literal", ~has_nul(token) & is_high_entropy(token))
        .otherwise(True)
    )


def release_tokens(
    files: DataFrame, kinds: tuple[str, ...] = tuple(P.SIGNALS), tails: bool = False
) -> DataFrame:
    """Evidence candidates of every release, file by file."""
    tokens = extract_tokens(_release_texts(files), kinds, tails=tails)
    return tokens.where(may_signal(F.col("kind"), F.col("token")))


def joined_release_tokens(files: DataFrame, kinds: tuple[str, ...] = tuple(P.SIGNALS)) -> DataFrame:
    """Evidence candidates of every release, written: the table both sides of a diff read.

    Hooks that go on in the next file of their release are found as well.
    """
    found = materialize(release_tokens(files, kinds, tails=True), "tokens")
    if "hook" not in kinds:
        return found
    texts = _release_texts(files)
    return join_split_hooks(found, lambda releases: texts.join(releases, list(RELEASE), "left_semi"), RELEASE)


def _release_texts(files: DataFrame) -> DataFrame:
    return strip_files(scannable_files(files.select(*RELEASE, "file_ord", "path", "content"))).drop("path")


def release_text(files: DataFrame, chunk_chars: int = 1 << 20) -> DataFrame:
    """(ecosystem, name, version, chunk, text): the comment-free text of releases, in pieces.

    Files stand in order, each ended by a line feed; the pieces of a release, in the order of
    their chunks, are its text.  A chunk is part of one file and tells its place as
    (file_ord, part), so nothing is gathered, however large a release or a file is.
    """
    text = F.concat("content", F.lit("\n"))
    parts = F.sequence(F.lit(0), F.floor((F.char_length("_text") - 1) / chunk_chars).cast("int"))
    cut = strip_files(scannable_files(files)).select("ecosystem", "name", "version", "file_ord", text.alias("_text"))
    return cut.select("*", F.explode(parts).alias("part")).select(
        "ecosystem", "name", "version", F.struct("file_ord", "part").alias("chunk"),
        F.substring(F.col("_text"), F.col("part") * chunk_chars + 1, F.lit(chunk_chars)).alias("text"),
    )


def joined_text(pieces: DataFrame) -> DataFrame:
    """(ecosystem, name, version, text): the pieces of each release put together in the order of their chunks.

    One value per release, so a release is as large as a value may be; :func:`write_release_text`
    has no such bound.  A file that a release holds twice must be one chunk.
    """
    placed = F.sort_array(F.collect_list(F.struct("chunk", "text")))
    joined = F.array_join(F.transform(placed, lambda p: p["text"]), "")
    return pieces.groupBy("ecosystem", "name", "version").agg(joined.alias("text"))


def write_release_text(text: DataFrame, path: str) -> None:
    """Pieces sorted by release and chunk across all files, so that one release is read from a few of them."""
    order = ["ecosystem", "name", "version", "chunk"]
    text.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
