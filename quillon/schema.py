"""Record types of operators and expressions."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

TEXT, INT, LONG, TEXTS = StringType(), IntegerType(), LongType(), ArrayType(StringType())
STEPS = ArrayType(StructType([StructField("info", TEXT), StructField("layer", INT)]))
LONGER = StructType([StructField("target_base", INT), StructField("flag", BooleanType())])

OPERATOR = StructType([
    StructField("id", LONG), StructField("func_id", TEXT), StructField("symbol", TEXT), StructField("n_ary", INT), StructField("unary_position", TEXT), StructField("n_order", INT), StructField("is_base", INT),
    StructField("definition", TEXT), StructField("definition_type", TEXT), StructField("priority", INT), StructField("associativity_direction", TEXT), StructField("op_compute_func", TEXT), StructField("op_count_func", TEXT), StructField("dependencies", TEXTS),
])
REQUIRED = ("func_id", "symbol", "n_ary")
EXPRESSION = StructType([
    StructField("id", LONG), StructField("expression_no_base_symbol", TEXT), StructField("expression", TEXT), StructField("highest_n_order", INT), StructField("priority_hierarchical_complexity", INT), StructField("normalized_expansion_degree", TEXT),
    StructField("operation_count", INT), StructField("complexity_ratio", DoubleType()), StructField("tree", TEXT), StructField("used_operators", TEXTS), StructField("dependent_operators", TEXTS), StructField("result", TEXT),
    StructField("longer_result_info", LONGER), StructField("cot_info", STEPS), StructField("base", INT), StructField("result_base", INT), StructField("text", TEXT), StructField("cot", STEPS),
])
