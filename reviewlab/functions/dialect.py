"""The few spots where Spark SQL and DuckDB SQL spell the same thing differently.

Expressions that must agree between the Spark job and its DuckDB check are
written once as SQL text and rendered for either engine through this module.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    name: str

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def lit(self, s: str) -> str:
        """A string literal; Spark SQL treats backslash as an escape sign."""
        if self.spark:
            return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "'" + s.replace("'", "''") + "'"

    def rx_replace(self, x: str, pattern: str, repl: str) -> str:
        if self.spark:
            return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(repl)})"
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(repl)}, 'g')"

    def rx_extract_all(self, x: str, pattern: str) -> str:
        if self.spark:
            return f"regexp_extract_all({x}, {self.lit(pattern)}, 0)"
        return f"regexp_extract_all({x}, {self.lit(pattern)})"

    def lam(self, var: str, body: str) -> str:
        if self.spark:
            return f"{var} -> {body}"
        return f"lambda {var}: {body}"

    def transform(self, arr: str, var: str, body: str) -> str:
        fn = "transform" if self.spark else "list_transform"
        return f"{fn}({arr}, {self.lam(var, body)})"

    def filter(self, arr: str, var: str, body: str) -> str:
        fn = "filter" if self.spark else "list_filter"
        return f"{fn}({arr}, {self.lam(var, body)})"

    def hex8(self, x: str) -> str:
        """First 8 hex digits of md5(x) as a non-negative bigint (uniform on [0, 2^32))."""
        if self.spark:
            return f"CAST(conv(substr(md5({x}), 1, 8), 16, 10) AS BIGINT)"
        return f"CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT)"

    def to_str(self, x: str) -> str:
        return f"CAST({x} AS {'STRING' if self.spark else 'VARCHAR'})"

    def array_join(self, arr: str, sep: str) -> str:
        if self.spark:
            return f"array_join({arr}, {self.lit(sep)})"
        return f"array_to_string({arr}, {self.lit(sep)})"

    def size(self, arr: str) -> str:
        return f"size({arr})" if self.spark else f"len({arr})"


SPARK = Dialect("spark")
DUCK = Dialect("duckdb")


def keyed_unit(d: Dialect, seed: str | int, key: str) -> str:
    """Deterministic uniform draw in [0, 1) from md5 of '<seed>:<key>'."""
    return f"({d.hex8(f'concat({d.lit(str(seed) + chr(58))}, {d.to_str(key)})')} / 4294967296.0e0)"


def keyed_bucket(d: Dialect, seed: str | int, key: str, buckets: int) -> str:
    """Deterministic bucket in [0, buckets) from md5 of '<seed>:<key>'."""
    return f"({d.hex8(f'concat({d.lit(str(seed) + chr(58))}, {d.to_str(key)})')} % {buckets})"
