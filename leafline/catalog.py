"""All operators' modules, imported so that their queries are registered."""

from leafline.operators import answers, cell_rules, comparing, layout, pages, pii, plans_of_pages, positions, search, tax, values
from leafline.plans import steps
from leafline.plans.registry import FLAGSHIP, ORACLES, QUERIES
from leafline.sources import files, html_reader, sinks
from leafline.streaming import meter

MODULES = (answers, cell_rules, comparing, files, html_reader, layout, meter, pages, pii, plans_of_pages, positions, search, sinks, steps, tax, values)
__all__ = ["FLAGSHIP", "MODULES", "ORACLES", "QUERIES"]
