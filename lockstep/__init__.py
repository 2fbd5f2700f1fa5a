"""lockstep: coordinated-activity analytics and record processing on Spark."""

__version__ = "0.1.0"
