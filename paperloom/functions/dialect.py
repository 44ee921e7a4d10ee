"""One rule, two engines: builders of SQL expressions for Spark and, as an oracle, for DuckDB."""

from __future__ import annotations


class Spark:
    """Spark SQL."""

    name = "spark"

    @staticmethod
    def text(s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_like({x}, {self.text(pattern)})"

    def extract(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, {self.text(pattern)}, {group})"

    def extract_all(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract_all({x}, {self.text(pattern)}, {group})"

    def replace(self, x: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)})"

    def swap(self, x: str, old: str, new: str) -> str:
        return f"replace({x}, {self.text(old)}, {self.text(new)})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def filter(self, x: str, body: str) -> str:
        return f"filter({x}, x -> {body})"

    def transform(self, x: str, body: str) -> str:
        return f"transform({x}, x -> {body})"

    def size(self, x: str) -> str:
        return f"CAST(size({x}) AS BIGINT)"

    def first(self, x: str) -> str:
        return f"try_element_at({x}, 1)"

    def last(self, x: str) -> str:
        return f"try_element_at({x}, -1)"

    def slice(self, x: str, n: int) -> str:
        return f"slice({x}, 1, {n})"

    def join(self, x: str, by: str) -> str:
        return f"array_join({x}, {self.text(by)})"

    def split(self, x: str, by: str) -> str:
        return f"split({x}, {self.text(''.join('[' + c + ']' if c != chr(10) else c for c in by))})"

    def struct(self, **parts: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in parts.items()) + ")"

    def best(self, x: str) -> str:
        return f"array_max({x})"

    def date(self, x: str, form: str) -> str:
        """form: ymd, mdy, dmy parted by - / . ; month names as B d Y, d b Y, d B Y; basic."""
        pattern = {"iso": "yyyy-MM-dd", "us": "M/d/yyyy", "eu": "d.M.yyyy", "B d Y": "MMMM d yyyy", "d B Y": "d MMMM yyyy", "d b Y": "d MMM yyyy", "basic": "yyyyMMdd"}[form]
        return f"try_to_date({x}, '{pattern}')"

    def words_capital(self, x: str) -> str:
        """A capital first letter of each word, the rest small."""
        return f"initcap({x})"

    def day(self, x: str) -> str:
        return f"date_format({x}, 'yyyy-MM-dd')"

    def key(self, m: str, key: str) -> str:
        return f"{m}['{key}']"

    def contains(self, x: str, part: str) -> str:
        return f"contains({x}, {self.text(part)})"

    def unaccent(self, x: str) -> str:
        plain = {"a": "áàâãäåāăą", "c": "çćč", "d": "ďđ", "e": "éèêëēėęě", "g": "ğģ", "i": "íìîïīį", "l": "ľļ", "n": "ñńňņ", "o": "óòôõöōő", "r": "řŕ", "s": "šśş", "t": "ťţ", "u": "úùûüūůű", "y": "ýÿ", "z": "žźż"}
        low, to = "".join(plain.values()), "".join(k * len(v) for k, v in plain.items())
        return f"translate({x}, '{low}{low.upper()}', '{to}{to.upper()}')"


class Duck(Spark):
    """DuckDB."""

    name = "duck"

    @staticmethod
    def text(s: str) -> str:
        body = "'" + s.replace("'", "''") + "'"
        return body if "\n" not in s and "\t" not in s else "(" + body.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + ")"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.text(pattern)})"

    def replace(self, x: str, pattern: str, by: str = "") -> str:
        by = by.replace("\\", "\\\\").replace("$1", "\\1").replace("$2", "\\2")
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(by)}, 'g')"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def filter(self, x: str, body: str) -> str:
        return f"list_filter({x}, lambda x: {body})"

    def transform(self, x: str, body: str) -> str:
        return f"list_transform({x}, lambda x: {body})"

    def size(self, x: str) -> str:
        return f"CAST(len({x}) AS BIGINT)"

    def first(self, x: str) -> str:
        return f"({x})[1]"

    def last(self, x: str) -> str:
        return f"({x})[-1]"

    def slice(self, x: str, n: int) -> str:
        return f"({x})[1:{n}]"

    def join(self, x: str, by: str) -> str:
        return f"coalesce(array_to_string({x}, {self.text(by)}), '')"

    def split(self, x: str, by: str) -> str:
        return f"string_split({x}, {self.text(by)})"

    def struct(self, **parts: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in parts.items()) + "}"

    def best(self, x: str) -> str:
        return f"list_max({x})"

    def date(self, x: str, form: str) -> str:
        pattern = {"iso": "%Y-%m-%d", "us": "%m/%d/%Y", "eu": "%d.%m.%Y", "B d Y": "%B %d %Y", "d B Y": "%d %B %Y", "d b Y": "%d %b %Y", "basic": "%Y%m%d"}[form]
        return f"CAST(try_strptime({x}, '{pattern}') AS DATE)"

    def words_capital(self, x: str) -> str:
        return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(left(w, 1)) || lower(substring(w, 2))), ' ')"

    def day(self, x: str) -> str:
        return f"strftime({x}, '%Y-%m-%d')"

    def contains(self, x: str, part: str) -> str:
        return f"contains({x}, {self.text(part)})"

    def unaccent(self, x: str) -> str:
        return f"strip_accents({x})"


SPARK, DUCK = Spark(), Duck()
