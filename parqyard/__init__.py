"""parqyard: Parquet tables in Spark, with an exact filter algebra, footers as tables, reports, JSON and writing."""

from .operators.predicates import all_of, any_of, contains, custom, eq, gt, gte, is_not_null, is_null, lt, lte, named, neq, predicate, prefix, suffix
from .operators.query import Table
from .types import F32, F64, I32, I64, Bool, Str

__all__ = ["F32", "F64", "I32", "I64", "Bool", "Str", "Table", "all_of", "any_of", "contains", "custom", "eq", "gt", "gte", "is_not_null", "is_null", "lt", "lte", "named", "neq", "predicate", "prefix", "suffix"]
