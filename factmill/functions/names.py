"""Names as PHP compares them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters PHP's trim() removes.
BLANKS = " \t\n\r\x0b\x00"


def php_name(c: Column | str) -> Column:
    """Comparison key of a class or method name: blanks at the ends, one leading backslash and letter case don't count.

    Null stays null; a name of blanks alone gives the empty string.
    """
    c = F.col(c) if isinstance(c, str) else c
    bare = F.btrim(c, F.lit(BLANKS))
    return F.lower(F.when(F.startswith(bare, F.lit("\\")), F.substring(bare, 2, 2**31 - 1)).otherwise(bare))


def basename(c: Column | str) -> Column:
    """The part of a qualified name after its last backslash."""
    return F.substring_index(c, "\\", -1)


def qualify(namespace: Column, name: Column) -> Column:
    """``namespace\\name``, without a separator where the namespace is empty or null."""
    return F.concat_ws("\\", F.nullif(namespace, F.lit("")), name)


def action_key(kind: Column, fqcn: Column, method: Column) -> Column:
    """``fqcn::method`` of controller actions; null for other kinds and where a part is empty."""
    known = kind.isin("controller_method", "invokable_controller") & (F.length(fqcn) > 0) & (F.length(method) > 0)
    return F.when(known, F.concat(fqcn, F.lit("::"), method))
