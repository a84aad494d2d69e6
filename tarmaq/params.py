"""Business constants and their boundary choices.

Every time-dependent operator takes an explicit ``as_of``; nothing in the
package reads the wall clock.
"""

from decimal import Decimal

# They decide results and must not drift.
LONG_FLIGHT_MINUTES = 360        # scheduling: long when minutes >= 360
REPORT_LONG_MINUTES = 360        # hours report: long when minutes > 360
HOLD_MINUTES = 15                # unpaid hold lapses when strictly older
CUSTOMER_CANCEL_HOURS = 36       # customer may cancel strictly earlier than this
FLIGHT_CANCEL_HOURS = 72         # manager may cancel this early or earlier
CANCEL_FEE = Decimal("0.05")
UTILISATION_DAYS = 30            # denominator of the monthly utilisation
SESSION_IDLE_MINUTES = 60
HISTORY_ROWS = 500
LISTING_ROWS = 200
TOP_ROUTES = 5
ORDER_CODE_WIDTH = 5
EARLIEST_DATE = "1900-01-01"
CREW_RULES = {  # trip length -> role -> exact head count
    "long": {"pilot": 3, "attendant": 6},
    "short": {"pilot": 2, "attendant": 3},
}

# State domains.
SCHEDULED, FULL, COMPLETED, CANCELLED = "Scheduled", "Full", "Completed", "Cancelled"
PENDING, ACTIVE = "Pending", "Active"
BY_CUSTOMER, BY_SYSTEM = "Cancelled by customer", "Cancelled by system"
FLIGHT_STATUSES = (SCHEDULED, FULL, COMPLETED, CANCELLED)
ORDER_STATUSES = (PENDING, ACTIVE, COMPLETED, BY_CUSTOMER, BY_SYSTEM)
OPEN_FLIGHT = (SCHEDULED, FULL)
FLOWN_FLIGHT = (COMPLETED, FULL)
VOID_ORDER = (BY_SYSTEM, BY_CUSTOMER)
PLANE_SIZES = ("Small", "Large")
MANUFACTURERS = ("Boeing", "Airbus", "Dassault")
CLASS_RANK = {"Business": 1, "Economy": 2}
