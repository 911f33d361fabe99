"""Values that must equal those of the analysed project for its results to be reproduced.

Fixed values, stated as text in the order the analysis uses them. Everything else in the
package is derived from these.
"""

# --- Fixed values: shipment status domain and the cleaning sentinel -------------------------
DELIVERED = "Delivered"
DELAYED = "Delayed"
LOST = "Lost"
RETURNED = "Returned"
UNKNOWN = "UNKNOWN"

# --- Fixed values: warehouse scorecard flag thresholds ----------------------------------------
DELIVERED_DROP_PP = -2.00      # delivered share this many points below the benchmark, or more
DELAY_RISE_PP = 2.00           # delay rate this many points above, or more
RETURN_RISE_PP = 0.70          # returned rate this many points above, or more
LOST_RISE_PP = 0.70            # lost rate this many points above, or more
COST_RISE_RATIO = 0.10         # cost per unit / per kg at least 10 % above

# --- Fixed values: minimum volume gates (HAVING COUNT(*) >= gate) -----------------------------
CARRIER_GATE = 30              # carrier 2x2 positioning
LANE_GATE = 20                 # worst lanes, lane delivered share
FOCUS_CARRIER_GATE = 20        # focus warehouse x carrier
FOCUS_LANE_GATE = 15           # focus lanes
DESTINATION_COST_GATE = 5      # destination cost drill
DESTINATION_DELAY_GATE = 10    # destination delay drill
VARIABILITY_GATE = 10          # warehouse x carrier variability
CARRIER_MONTH_GATE = 5         # carrier monthly trend

FOCUS_K = 3                    # drill into the first three warehouses of the priority scorecard
HIGH_VOLUME_GATE = 20          # "bad KPI + enough volume" segments

# --- Fixed values: carrier 2x2 positioning labels (median benchmark) --------------------------
FAST_EXPENSIVE = "FAST but EXPENSIVE"
FAST_CHEAP = "FAST and CHEAP (best)"
SLOW_EXPENSIVE = "SLOW and EXPENSIVE (worst)"
SLOW_CHEAP = "SLOW but CHEAP"
MEDIAN = 0.5

# --- Fixed values: shipment profile buckets (upper edge exclusive, label) ---------------------
WEIGHT_BUCKETS = ((10, "Light (< 10kg)"), (50, "Medium (10-50kg)"), (100, "Heavy (50-100kg)"),
                  (None, "Very Heavy (100kg+)"))
COST_BUCKETS = ((50, "Budget (< $50)"), (100, "Standard ($50-100)"), (200, "Premium ($100-200)"),
                (None, "Expensive (200+)"))
DISTANCE_BUCKETS = ((100, "Short (< 100mi)"), (500, "Medium (100-500mi)"), (1000, "Long (500-1000mi)"),
                    (None, "Very Long (1000mi+)"))

# --- Fixed values: decision scorecard labels, cut-offs and recommendations --------------------
CRITICAL = "🔴 CRITICAL"
HIGH_RISK = "🟠 HIGH RISK"
EXPENSIVE = "🟡 EXPENSIVE"
GOOD = "🟢 GOOD"
DELIVERED_FLOOR = 85           # delivered share below this: CRITICAL
PROBLEM_CEILING = 2            # lost + returned share above this: HIGH RISK
COST_PER_KG_CEILING = 10       # cost per kg above this: EXPENSIVE
RECOMMENDATION = {
    CRITICAL: "URGENT: Optimize performance + reduce cost",
    HIGH_RISK: "PRIORITY: Improve quality control",
    EXPENSIVE: "FOCUS: Negotiate better rates",
    GOOD: "MAINTAIN: Current performance is good",
}
SEVERITY = {CRITICAL: 1, HIGH_RISK: 2, EXPENSIVE: 3, GOOD: 4}

# --- Fixed values: IQR outlier fence -----------------------------------------------------------
Q1, Q3 = 0.25, 0.75
IQR_FENCE = 1.5

# --- Fixed values: chart feeds -----------------------------------------------------------------
TOP_K = 10
LANE_ARROW = " → "

# --- Fixed values: names from the analysed project's own data (library defaults only) ----------
DEFAULT_FOCUS = ("Warehouse_HOU", "Warehouse_SF", "Warehouse_MIA")
DEFAULT_COST_DRILL = ("Warehouse_HOU", "UPS")
DEFAULT_DELAY_DRILL = ("Warehouse_HOU", "Amazon Logistics")
