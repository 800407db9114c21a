"""Document fingerprints by invertible Bloom lookup sketches of paragraph pieces.

A text is a set of pieces.  The registered query cuts it ``fine``: at line ends,
at every sentence or clause end (white space after a character that is no letter,
digit or comma, and after full stops of scripts without spaces), and in the first
part of a line (all of it, where it has no such end) and in long parts at
content-defined places: after words whose hash is 0 modulo ``EVERY`` (in words
of over ``LONG_WORD`` characters after characters whose hash is 0 modulo ``EVERY_CHAR``).  So cuts
depend on what is near them only, and short or single-line texts have several pieces.
Without ``fine`` lines are cut only after sentence ends whose last letter is a to m.
A piece is a number of 62 hashed bits: the topmost, up to 16, deal it to a group, 34
choose cells, 12 check those.  The number of groups grows with the text, so a group has
up to about 4 pieces.  Pieces are sorted, so a group is a slice whose ends are found by
halving, and the work for a text grows little faster than its length.

A group's sketch has three tables of cells; a piece is added to one cell of each.
A cell is one long, ``count * 2**52 + sum of pieces``.  Sketches of two versions
subtract cell by cell, which leaves their symmetric difference; peeling takes
cells whose count is 1 or -1 and whose check bits agree, takes that piece out of
its other cells, and goes on: it recovers the digests that only one version has, and on
which side.  If cells are left, the group is tried again with larger tables, and at last
by an exact set difference.

Likeness is the number of common pieces over that of all pieces, 1 for two empty
texts.  With ``whole`` results hold the sketches, which can be stored and subtracted
(``subtracted``), and the recovered digests.  Only DataFrame and SQL functions.

Rows are dealt by quantiles of their ids to buckets of neighbours, whatever the ids are;
a text's pieces are made once and travel with it to the document before it.

Defined results: null is the empty text; equal texts have equal fingerprints;
repeated pieces count once; null ids come before all others; rows of one id, or of none,
follow each other by a hash of their text and get a result each; a single row is its own
next document; texts of any length are read whole; an empty table gives an empty table;
other columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, materialize

#: Cells of a table at first and when tried again, peeling rounds, pieces of a group.
CELLS, RETRIES, ROUNDS, GROUP = 4, (8, 32, 128, 1024), 16, 4
#: Peeling rounds of the smallest sketches; what needs more is tried again.
FEW_ROUNDS = 3
#: Bits of a piece that deal to groups, at most, above the bits that choose and check cells; one in the count.
GROUP_BITS, KEY_BITS, ONE = 16, 46, 1 << 52
#: Lowest of the 11 bits that choose the cell in each table; below them are the check bits.
TABLES = (12, 23, 34)
CHECK = (1 << 12) - 1
#: Rows that a bucket of neighbouring ids should hold, and buckets at most.
BUCKET_ROWS, BUCKETS = 4_000, 10_000
#: Characters of bucket borders that may be broadcast.
BROADCAST_CHARS = 32_000_000

#: One in so many words, or characters, ends a piece in the first part of a line and in parts longer than so many characters.
EVERY, EVERY_CHAR, LONG = 8, 16, 160
#: Longer words are runs of a script without spaces.
LONG_WORD = 48


def fine_parts(text: str) -> str:
    """SQL: a text cut at lines, sentence and clause ends, and by word hashes elsewhere."""
    ends = "(?=\\\\s)(?<=[^\\\\p{L}\\\\p{N},\\\\s])\\\\s+|(?<=[。！？；।])(?=[^\\\\s])"
    ended = lambda x, of: f"if(pmod(xxhash64({x}), {of}) = 0, concat({x}, '\\n'), {x})"
    chars = f"array_join(transform(split(v, ''), c -> {ended('c', EVERY_CHAR)}), '')"
    by_hash = f"split(array_join(transform(split(u, ' '), v -> if(length(v) > {LONG_WORD}, {chars}, {ended('v', EVERY)})), ' '), '\\n')"
    line = f"{_bind(f"split(y, '{ends}')", 'us', f'flatten(transform(us, (u, i) -> if(i = 0 or length(u) > {LONG}, {by_hash}, array(u))))')}"
    return f"array_remove(transform(flatten(transform(split({text}, '\\\\n+'), y -> {line})), u -> trim(u)), '')"


def pieces(text: str, fine: bool = False) -> str:
    """SQL: distinct numbers of the pieces of a text."""
    parts = fine_parts(text) if fine else f"array_remove(split({text}, '(?=\\\\s)(?<=[a-m] ?[^\\\\p{{L}}\\\\p{{N}}\\\\s,]{{1,4}})\\\\s+|\\\\n+'), '')"
    number = f"shiftleft(h & {(1 << GROUP_BITS + 34) - 1}L, 12) | (xxhash64(h & {(1 << 34) - 1}L) & {CHECK}L)"
    return f"array_distinct(transform(transform({parts}, u -> xxhash64(u)), h -> {number}))"


def groups(sets: str) -> str:
    """SQL: binary logarithm of the number of groups."""
    return f"least({GROUP_BITS}, greatest(0, cast(ceil(log2(greatest(size({sets}), 1) / {GROUP}.0D)) as int)))"


def _bind(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _below(numbers: str, n: str, bound: str, halves: str) -> str:
    """SQL: how many of the sorted numbers are less than a bound, by halving."""
    return f"aggregate({halves}, 0, (p, s) -> if(p + s <= {n} and element_at({numbers}, greatest(1, least(p + s, {n}))) < {bound}, p + s, p))"


def grouped(sets: str, bits: str) -> str:
    """SQL: what each piece adds to cells, by group: slices of the sorted pieces."""
    add = f"(x & {(1 << KEY_BITS) - 1}L) + {ONE}L"
    halves = "transform(sequence(cast(floor(log2(greatest(size(o), 1))) as int), 0, -1), i -> shiftleft(1, i))"
    ends = f"transform(sequence(1L, shiftleft(1L, {bits}) - 1L), g -> {_below('o', 'size(o)', f'shiftleft(g, {GROUP_BITS + KEY_BITS} - {bits})', 'hv')})"
    many = f"if({bits} = 0, array(size(o)), concat({ends}, array(size(o))))"
    cut = f"transform(es, (e, i) -> transform(slice(o, 1 + if(i = 0, 0, es[greatest(i, 1) - 1]), e - if(i = 0, 0, es[greatest(i, 1) - 1])), x -> {add}))"
    return _bind(f"sort_array({sets})", "o", f"if(size(o) = 0, array(cast(array() as array<bigint>)), {_bind(halves, 'hv', _bind(many, 'es', cut))})")


def sketch(pieces_of_group: str, w: str, of: str = "x") -> str:
    """SQL: the 3 * w cells of a group; ``of`` gives the bits of a piece ``x`` that choose its cells."""
    tables = (f"transform(sequence(0L, {w} - 1L), j -> aggregate({pieces_of_group}, 0L, (a, x) -> if((shiftright({of}, {t}) & ({w} - 1L)) = j, a + x, a)))" for t in TABLES)
    return f"concat({', '.join(tables)})"


def _less(p: str, q: str) -> str:
    return f"zip_with({p}, {q}, (p, q) -> p - q)"


def _peeled(cells: str, w: str, rounds: int = ROUNDS) -> str:
    """SQL: the pieces in a difference of sketches, as they are added to cells and negative if they are the second's; null if it can't be peeled."""
    single = f"shiftright(abs(c), {KEY_BITS}) = {ONE >> KEY_BITS} and (xxhash64(shiftright(abs(c), 12) & {(1 << 34) - 1}L) & {CHECK}L) = (abs(c) & {CHECK}L)"
    own = sketch("pure", w, "abs(x)")
    none = "cast(array() as array<bigint>)"
    step = _bind(f"array_distinct(filter(st.cells, c -> {single}))", "pure", f"if(size(pure) = 0, st, named_struct('cells', zip_with(st.cells, {own}, (c, s) -> c - s), 'found', concat(st.found, pure)))")
    peeled = f"aggregate(sequence(1, {rounds}), named_struct('cells', ce, 'found', {none}), (st, r) -> {step}, st -> if(forall(st.cells, c -> c = 0L), st.found, cast(null as array<bigint>)))"
    return _bind(cells, "ce", f"if(forall(ce, c -> c = 0L), {none}, {peeled})")


def sketches(sets: str, bits: str) -> str:
    """SQL: the smallest sketches of all groups."""
    return f"transform({grouped(sets, bits)}, z -> {sketch('z', f'{CELLS}L')})"


def subtracted(a: str, b: str, sketches_a: str, sketches_b: str) -> str:
    """SQL: the pieces in just one of two sets, by group, from subtracting and peeling their sketches; the second's are negative.

    Sketches of as many groups as the larger set has are subtracted as they are;
    the others are made anew.
    """
    left = f"if({groups(a)} = m, {sketches_a}, {sketches(a, 'm')})"
    right = f"if({groups(b)} = m, {sketches_b}, {sketches(b, 'm')})"
    first = f"zip_with({left}, {right}, (sa, sb) -> {_peeled(_less('sa', 'sb'), f'{CELLS}L', FEW_ROUNDS)})"
    mine = lambda sets: f"transform(filter({sets}, x -> shiftright(x, {GROUP_BITS + KEY_BITS} - m) = i), x -> (x & {(1 << KEY_BITS) - 1}L) + {ONE}L)"
    exact = "concat(array_except(z.a, z.b), transform(array_except(z.b, z.a), x -> -x))"
    larger = f"""aggregate(array({', '.join(f'{w}L' for w in RETRIES)}), cast(null as array<bigint>),
      (d, w) -> if(d is not null, d, {_peeled(_less(sketch('z.a', 'w'), sketch('z.b', 'w')), 'w')}), d -> if(d is not null, d, {exact}))"""
    again = f"transform(ds, (d, i) -> if(d is not null, d, {_bind(f'named_struct(%sa%s, {mine(a)}, %sb%s, {mine(b)})'.replace('%s', chr(39)), 'z', larger)}))"
    return _bind(f"greatest({groups(a)}, {groups(b)})", "m", _bind(first, "ds", f"if(forall(ds, d -> d is not null), ds, {again})"))


def likeness(a: str, b: str, difference: str) -> str:
    """SQL: common pieces over all pieces, from sizes and the difference."""
    both, apart = f"(size({a}) + size({b}))", f"aggregate({difference}, 0, (s, d) -> s + size(d))"
    return f"if({both} = 0, 1.0D, {_bind(apart, 'dd', f'({both} - dd) / cast({both} + dd as double)')})"


def digest(cells: str) -> str:
    """SQL: 32 hex digits that stand for sketches."""
    return _bind(cells, "s", "lower(concat(lpad(hex(xxhash64(s, 1)), 16, '0'), lpad(hex(xxhash64(s, 2)), 16, '0')))")


def with_next(docs: DataFrame, made: str, also: str) -> DataFrame:
    """``id, text, a, sa, next_text, b, sb`` of ``docs(id, text)``: ``a`` is what the SQL ``made`` makes of a text, ``sa`` what ``also`` makes of ``a``; the others are those of the row of the next id, after the last the first.

    Rows are dealt to buckets of neighbouring ids between quantiles; inside a bucket a
    window gives the next row, and the first rows of buckets are joined to the last
    ones of those before.
    """
    spark = docs.sparkSession
    total = docs.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(1, min(BUCKETS, max(4 * parts, total // BUCKET_ROWS), total))
    bounds: list[int] = []
    if wanted > 1:
        shares = ", ".join(repr(k / wanted) for k in range(1, wanted))
        found = docs.selectExpr("id").agg(F.expr(f"percentile_approx(id, array({shares}), {max(10_000, 10 * wanted)})")).first()[0]
        bounds = sorted(set(found or []))
    low = "(-9223372036854775807L - 1L)"
    numbers = "array(" + ", ".join(low if b == -(1 << 63) else f"{b}L" for b in bounds) + ")"
    halves = "array(" + ", ".join(str(1 << k) for k in range(max(len(bounds), 1).bit_length() - 1, -1, -1)) + ")"
    bucket = F.expr(_below(numbers, str(len(bounds)), f"coalesce(id, {low})", halves)) if bounds else F.lit(0)
    rows = docs.withColumn("bucket", bucket).withColumn("tie", F.xxhash64("text"))
    by = [F.col("id").asc_nulls_first(), F.col("tie")]
    order = Window.partitionBy("bucket").orderBy(*by)
    near = rows.select("*", F.lead("text").over(order).alias("next_text"))
    # made after the shuffle, and handed on by a window over the same order
    near = near.withColumn("a", F.expr(made)).withColumn("sa", F.expr(also)).select("*", F.lead("a").over(order).alias("next_a"), F.lead("sa").over(order).alias("next_sa"))
    # a bucket's first row; ids and ties only, then the texts of those few
    held = firsts = materialize(rows.groupBy("bucket").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "tie")).alias("f")).selectExpr("bucket as b", "f.id as first_id", "f.tie as first_tie"), "firsts")
    have = sorted(r["b"] for r in firsts.select("b").collect())
    before = spark.createDataFrame([(b, have[k - 1]) for k, b in enumerate(have)] or [(0, 0)], "b int, before int")
    firsts = firsts.join(F.broadcast(before), "b")  # at most as many rows as there are buckets
    head = rows.join(F.broadcast(firsts), (F.col("b") == F.col("bucket")) & F.col("first_id").eqNullSafe(F.col("id")) & (F.col("first_tie") == F.col("tie")))
    head = materialize(head.dropDuplicates(["bucket"]).select("before", F.col("text").alias("head_text"), F.expr(made).alias("a")).select("*", F.expr(also).alias("head_sa")).withColumnRenamed("a", "head_a"), "borders")
    discard(held)
    chars = head.agg(F.sum(F.length("head_text"))).first()[0] or 0
    last = F.col("next_text").isNull()
    if chars <= BROADCAST_CHARS:
        joined = near.join(F.broadcast(head), last & (F.col("bucket") == F.col("before")), "left")
    else:  # other rows get a key of their own, which meets nothing
        own = F.when(last, F.col("bucket").cast("bigint")).otherwise(-1 - F.pmod(F.xxhash64("id", "tie"), F.lit(1 << 40)))
        joined = near.withColumn("own", own).join(head.withColumn("own", F.col("before").cast("bigint")), "own", "left")
    return joined.select("id", "text", "a", "sa", *(F.coalesce(f"next_{x}", f"head_{x}").alias(y) for x, y in (("text", "next_text"), ("a", "b"), ("sa", "sb"))))


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last quarter replaced by as many characters of the next."""
    q = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - q), F.substring(next_text, F.lit(1), q))


def fingerprint_versions(docs: DataFrame, text: str = "text", key: str = "doc_id", fine: bool = False, whole: bool = False) -> DataFrame:
    """Per row its fingerprint and that of its edited text, and their likeness and that to the next document.

    With ``whole`` also ``sketch`` and ``edited_sketch``, by group, and ``gone`` and ``added``:
    the digests of the pieces that only the text, or only the edited text, has, as
    recovered by peeling (a digest without the bits of its group).
    """
    plain = docs.selectExpr(f"cast(`{key}` as bigint) as id", f"coalesce(cast(`{text}` as string), '') as text")
    rows = with_next(plain, pieces("text", fine), sketches("a", groups("a"))).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    sets = rows.select("id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "a", "sa", F.expr(pieces("edited", fine)).alias("e"), "b", "sb")
    # explode(array(x)) keeps the optimizer from writing x out again at each use
    made = sets.select("*", F.explode(F.array(F.expr(sketches("e", groups("e"))))).alias("se"))
    made = made.select("*", F.explode(F.array(F.expr(subtracted("a", "e", "sa", "se")))).alias("edits"))
    value = f"abs(x) & {ONE - 1}L"
    return made.selectExpr(
        "id as doc_id",
        "n_chars",
        "edited_sha256",
        f"{digest('sa')} as fingerprint",
        f"{digest('se')} as edited_fingerprint",
        f"{likeness('a', 'e', 'edits')} as near_edited",
        f"{likeness('a', 'b', subtracted('a', 'b', 'sa', 'sb'))} as near_next",
        *(["sa as sketch", "se as edited_sketch", f"transform(filter(flatten(edits), x -> x > 0), x -> {value}) as gone", f"transform(filter(flatten(edits), x -> x < 0), x -> {value}) as added"] if whole else []),
    )
