"""Session properties and the environment functions (Sys)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

from lumenrel.plans.errors import Fail
from lumenrel.plans.query import Query

#: Properties and their defaults. Those of the shell are kept and have no effect on results.
DEFAULTS: dict[str, Any] = {
    "banner": "", "colorScheme": None, "directory": "", "echo": False, "excludeStructures": "^Test$", "hybrid": False, "idempotent": False, "inlinePassCount": 5, "lineWidth": 79, "matchCoverageEnabled": True,
    "matchStrict": False, "maxUseDepth": -1, "mode": "validate", "now": None, "output": "classic", "printDepth": 5, "printLength": 12, "productName": "lumenrel", "productVersion": "0.1", "rangeMaxLength": 2**24 - 1,
    "relationalize": False, "scriptDirectory": "", "showBanner": True, "stringDepth": 70, "stringFold": False, "terminalBackground": None, "timeZone": None,
}


class Sys:
    """set, unset, show, showAll, env, plan and clearEnv of one session."""

    def __init__(self, spark: SparkSession, env: dict[str, Any] | None = None) -> None:
        self.spark, self.values, self.names = spark, {}, env if env is not None else {}

    def _known(self, name: str) -> None:
        if name not in DEFAULTS:
            raise Fail(f"property {name} not found")

    def set(self, name: str, value: Any) -> None:
        self._known(name)
        default = DEFAULTS[name]
        if default is not None and not isinstance(value, type(default)):
            raise Fail(f"property {name} needs a {type(default).__name__}")
        self.values[name] = value
        if name == "timeZone":
            self.spark.conf.set("spark.sql.session.timeZone", value)

    def unset(self, name: str) -> None:
        self._known(name)
        self.values.pop(name, None)
        if name == "timeZone":
            self.spark.conf.unset("spark.sql.session.timeZone")

    def get(self, name: str) -> Any:
        self._known(name)
        return self.values.get(name, DEFAULTS[name])

    def show(self, name: str) -> str:
        value = self.get(name)
        return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)

    def show_all(self) -> list[tuple[str, str]]:
        return [(n, self.show(n)) for n in sorted(DEFAULTS)]

    def env(self) -> list[tuple[str, str]]:
        return [(n, type(v).__name__) for n, v in sorted(self.names.items()) if not n.startswith("$")]

    def clear_env(self) -> None:
        for n in [n for n in self.names if not n.startswith("$")]:
            del self.names[n]

    @staticmethod
    def plan(q: Query) -> str:
        return q.plan()
