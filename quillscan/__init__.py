"""quillscan: a PySpark-native engine for manuscript review signals and corpus preparation."""

from quillscan.plans.analyze import Analysis, analyze, compared, fails, search
from quillscan.plans.report import redacted, write_comparison, write_reports
from quillscan.plans.rules import load_rules
from quillscan.sources.files import parse_source, read_text_safely
from quillscan.tables import Tables, from_texts

__all__ = ["Analysis", "Tables", "analyze", "compared", "fails", "from_texts", "load_rules", "parse_source", "read_text_safely", "redacted", "search", "write_comparison", "write_reports"]
