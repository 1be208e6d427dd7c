"""Fixed values that must equal the reference's for right results.

All values below are stated as plain text in their natural order.
"""

# --- fixed values: domain enums -------------------------------------------
ITEM_TYPES = ["CHAIR", "TABLE", "SHELF", "CLOSET"]
ORDER_COLOURS = ["RED", "GREEN", "BLUE", "YELLOW"]  # one per grid column y=0..3

# --- fixed values: blocks per item ----------------------------------------
BLOCK_COUNT = {"CHAIR": 1, "TABLE": 2, "SHELF": 2, "CLOSET": 3}

# --- fixed values: assembly plans, item -> ordered (x, y, z) ---------------
ASSEMBLY_PLAN = {
    "CHAIR": [(0, 0, 0)],
    "TABLE": [(0, 0, 0), (1, 0, 0)],
    "SHELF": [(0, 0, 0), (0, 0, 1)],
    "CLOSET": [(0, 0, 0), (0, 0, 1), (0, 0, 2)],
}

# --- fixed values: robot geometry (inventory and assembly) ----------------
INVENTORY_X_STEP = 27
INVENTORY_Y_STEP = 27
INVENTORY_Z_PICKUP = -12
ASSEMBLY_Z_INITIAL = 85
ASSEMBLY_CUBE_SIZE = 26

# --- fixed values: stock grid ---------------------------------------------
GRID_COLS = 4

# --- fixed values: tracker ------------------------------------------------
STEP_LABELS = ["Order Received", "Inventory Reserved", "Manufacturing", "Completed"]

# --- fixed values: topics -------------------------------------------------
INFO_TOPIC = "info.v1"
ERROR_TOPIC = "error.v1"
COMPLETE_TOPIC = "order.complete.v1"
MANUFACTURE_TOPIC = "order.manufacture.v1"
DASHBOARD_TOPICS = [INFO_TOPIC, ERROR_TOPIC, COMPLETE_TOPIC]
UNKNOWN_ORDER = "unknown-order"
NOTIFICATION_KEY = "0"

# --- fixed values: reservation outcomes -----------------------------------
INSUFFICIENT_BLOCKS = "INSUFFICIENT_BLOCKS"
TECHNICAL_OR_INVALID = "TECHNICAL_OR_INVALID_REQUEST"

# --- fixed values: restock failure stages (activity id -> stage, code) -----
FAILURE_STAGES = [
    ("Activity_0uhz0y6", "AFTER_TIMEOUT", "INVENTORY_RESTORE_TIMEOUT_FAILED"),
    ("Activity_0ezfqp2", "AFTER_FACTORY_ERROR", "INVENTORY_RESTORE_FACTORY_FAILED"),
]
FAILURE_STAGE_DEFAULT = ("UNKNOWN", "INVENTORY_RESTORE_TIMEOUT_FAILED")

# --- fixed values: sensors ------------------------------------------------
PICKUP_DISTANCE_LIMIT = 25.0
SENSOR_WAIT_SECONDS = 30
LATENCY_PROGRESS_EVERY = 5000
LUX_DEVICE_FACTOR = 310.0
LUX_R_COEF = 0.136
LUX_G_COEF = 1.0
LUX_B_COEF = -0.444
CCT_COEF = 3810
CCT_OFFSET = 1391
