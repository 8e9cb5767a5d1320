"""Vocabulary of a record table: its fields, its label and the rule under study."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Clause:
    """One equality clause of an OR-rule, with the value that clears it."""

    column: str
    value: str
    clear: str


@dataclass(frozen=True)
class Vocabulary:
    """Everything a rendering, rule or probe job must know about a record table."""

    fields: tuple[str, ...]
    target: str
    clauses: tuple[Clause, Clause]
    system: str
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    missing: str = "None"
    non_rule_edits: dict[str, str] = field(default_factory=dict)
    extra_edits: dict[str, tuple[str, ...]] = field(default_factory=dict)
    paired_edits: tuple[tuple[str, str, tuple[tuple[str, str], ...]], ...] = ()
    trigger_fields: tuple[tuple[str, str], ...] = ()

    @property
    def rule_fields(self) -> tuple[str, ...]:
        return tuple(c.column for c in self.clauses)


# --- Fixed values -----------------------------------------------------------------------
# Texts and value lists that must equal the published ones for results to match.

SYSTEM_TEXT = (
    "Assume you are a supply chain analyst. Based on the following information, "
    "output the result for Logistics_Delay, where 1 represents a delay and 0 represents no delay."
)

LOGISTICS = Vocabulary(
    fields=(
        "Timestamp", "Asset_ID", "Latitude", "Longitude", "Inventory_Level",
        "Shipment_Status", "Temperature", "Humidity", "Traffic_Status", "Waiting_Time",
        "User_Transaction_Amount", "User_Purchase_Frequency", "Logistics_Delay_Reason",
        "Asset_Utilization", "Demand_Forecast",
    ),
    target="Logistics_Delay",
    clauses=(
        Clause("Shipment_Status", "Delayed", "In Transit"),
        Clause("Traffic_Status", "Heavy", "Clear"),
    ),
    system=SYSTEM_TEXT,
    numeric=(
        "Latitude", "Longitude", "Inventory_Level", "Temperature", "Humidity", "Waiting_Time",
        "User_Transaction_Amount", "User_Purchase_Frequency", "Asset_Utilization", "Demand_Forecast",
    ),
    categorical=("Asset_ID", "Shipment_Status", "Traffic_Status", "Logistics_Delay_Reason"),
    non_rule_edits={
        "Timestamp": "2024-12-30 20:21:58",
        "Asset_ID": "Truck_10",
        "Latitude": "0.0",
        "Longitude": "0.0",
        "Inventory_Level": "500",
        "Temperature": "30.0",
        "Humidity": "80.0",
        "Waiting_Time": "60",
        "User_Transaction_Amount": "500",
        "User_Purchase_Frequency": "10",
        "Logistics_Delay_Reason": "Traffic",
        "Asset_Utilization": "100.0",
        "Demand_Forecast": "300",
    },
    extra_edits={"Logistics_Delay_Reason": ("Mechanical Failure", "None")},
    paired_edits=(
        ("negatives_waiting60_temp30", "negatives", (("Waiting_Time", "60"), ("Temperature", "30.0"))),
        ("positives_waiting10_temp18", "positives", (("Waiting_Time", "10"), ("Temperature", "18.0"))),
    ),
    trigger_fields=(
        ("Heavy", "Logistics_Delay_Reason"),
        ("Delayed", "Logistics_Delay_Reason"),
        ("Delayed", "Asset_ID"),
    ),
)

# Rewrites of the two trigger values: value -> kind of rewrite.
STATUS_REWRITES = {
    "DELAYED": "case", "delayed": "case",
    "Late": "synonym", "Behind schedule": "synonym", "Postponed": "synonym",
    "Overdue": "synonym", "Held up": "synonym",
    "On Time": "antonym", "Early": "antonym",
    "Pending": "neighbour", "Not Delayed": "negation", "Delay": "shared_token",
}
TRAFFIC_REWRITES = {
    "HEAVY": "case", "heavy": "case",
    "Congested": "synonym", "Jammed": "synonym", "Gridlock": "synonym",
    "Slow": "synonym", "Dense": "synonym",
    "Light": "antonym", "Free-flowing": "antonym",
    "Moderate": "neighbour", "Not Heavy": "negation", "Heav": "shared_token",
}
CONTROL_WORDS = (
    "Copper", "Violet", "Harbor", "Maple", "Quartz", "Falcon",
    "Meadow", "Cobalt", "Lantern", "Marble", "Willow", "Amber",
)
RENAMES = {"Shipment_Status": "Status", "Traffic_Status": "Traffic"}
UNSEEN = {"Shipment_Status": "Unknown", "Traffic_Status": "N/A"}
FREE_TEXT = "Note: the depot supervisor is Mr. {value}"
TRIGGER_STEMS = {"Shipment_Status": "delay", "Traffic_Status": "heav"}
FOREIGN_RECORD = (
    "order_id: 123\norigin_region: OH\ndest_region: CA\ncarrier: A1\nservice_level: ground\n"
    "weight_kg: 10.5\ndistance_km: 3500\nholiday_flag: 0"
)
FOREIGN_QUESTION = "What is the capital of France? Answer in one word."
# --- end of fixed values ----------------------------------------------------------------
