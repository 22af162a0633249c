"""Extension points: parsers, exporters and constraint evaluators by name, and plugins that add them.

A plugin is a module (or an entry point of the group below) with API_VERSION and register(registry).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.metadata import entry_points

from graphloom.operators import conformance
from graphloom.sources import export, items
from graphloom.sources.orchestrate import ORCHESTRATORS

API_VERSION = 1
GROUP = "graphloom.plugins"


class PluginError(RuntimeError):
    """A plugin that does not fit."""


@dataclass
class Registry:
    parsers: dict[str, Callable] = field(default_factory=lambda: dict(items.PARSERS))
    exporters: dict[str, Callable] = field(default_factory=lambda: {"dot": export.dot_lines, "mermaid": export.mermaid_lines, "c4": export.c4_lines})
    edge_checks: dict[str, Callable] = field(default_factory=lambda: dict(conformance.EDGE_CHECKS))
    node_checks: dict[str, Callable] = field(default_factory=lambda: dict(conformance.NODE_CHECKS))
    orchestrators: dict[str, object] = field(default_factory=lambda: dict(ORCHESTRATORS))
    plugins: dict[str, object] = field(default_factory=dict)

    def add(self, name: str, plugin) -> None:
        if getattr(plugin, "API_VERSION", None) != API_VERSION:
            raise PluginError(f"{name} is for API version {getattr(plugin, 'API_VERSION', None)}, not {API_VERSION}")
        plugin.register(self)
        self.plugins[name] = plugin

    def load(self, module: str) -> None:
        self.add(module, importlib.import_module(module))

    def discover(self) -> list[str]:
        """Load all installed plugins; returns their names."""
        for e in entry_points(group=GROUP):
            self.add(e.name, e.load())
        return sorted(self.plugins)

    def remove(self, name: str) -> None:
        if name not in self.plugins:
            raise PluginError(f"no plugin {name}")
        del self.plugins[name]

    def info(self) -> list[tuple[str, str]]:
        return [(n, (getattr(p, "__doc__", "") or "").strip().split("\n")[0]) for n, p in sorted(self.plugins.items())]
