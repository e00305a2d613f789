"""The template and the rulebook: rules are data, authored here."""

from tallyspark.operators.mapping import Concept

CA, CL = "bs_current_assets", "bs_current_liabilities"
LEAVES = (f"{CA}__inventories", f"{CA}__trade_receivables", f"{CA}__others", f"{CL}__current_trade_payables", f"{CL}__current_borrowings", f"{CL}__others")
#: (parent, op, children), in any order; children may be parents.
ROLLUPS = (
    ("bs_net_current", "diff", (f"{CA}__total_current_assets", f"{CL}__total_current_liabilities")),
    (f"{CA}__total_current_assets", "sum", LEAVES[:3]),
    (f"{CL}__total_current_liabilities", "sum", LEAVES[3:]),
)
LABELS = {
    LEAVES[0]: "Inventories", LEAVES[1]: "Trade receivables", LEAVES[2]: "Other current assets", LEAVES[3]: "Trade payables",
    LEAVES[4]: "Borrowings", LEAVES[5]: "Other current liabilities", ROLLUPS[1][0]: "Total current assets", ROLLUPS[2][0]: "Total current liabilities", "bs_net_current": "Net current assets",
}
#: (ratio, unit factor, numerator terms, denominator terms): a term is (key, sign, optional).
RATIOS = (
    ("current_ratio", 1.0, ((ROLLUPS[1][0], 1, False),), ((ROLLUPS[2][0], 1, False),)),
    ("quick_ratio", 1.0, ((ROLLUPS[1][0], 1, False), (LEAVES[0], -1, False)), ((ROLLUPS[2][0], 1, False),)),
    ("debt_share", 100.0, ((LEAVES[4], 1, False),), ((ROLLUPS[2][0], 1, False),)),
    ("working_capital_to_assets", 1.0, (("bs_net_current", 1, False),), ((ROLLUPS[1][0], 1, False),)),
    ("receivables_to_payables", 1.0, ((LEAVES[1], 1, False),), ((LEAVES[3], 1, False),)),
    ("net_debt_to_assets", 1.0, ((LEAVES[4], 1, False), (LEAVES[2], -1, True)), ((ROLLUPS[1][0], 1, False),)),
)
#: Concepts that captions may be bound to, of a small rulebook.
CONCEPTS = (
    Concept(LEAVES[0], aliases=("red widget",), priority=20),
    Concept(LEAVES[1], aliases=("blue bolt",), priority=10, regex=("gizmo$",), excludes=("blue",)),
    Concept(LEAVES[2], aliases=("red widget",), priority=10),
    Concept(LEAVES[4], aliases=("hot gear",), priority=5),
    Concept(LEAVES[3], aliases=("small ring",), priority=5, confusable=(LEAVES[5],)),
    Concept(LEAVES[5], aliases=("small ring",), priority=5, confusable=(LEAVES[3],), regex=("^cold ",)),
)
