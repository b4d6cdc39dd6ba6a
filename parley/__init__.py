"""parley: support-conversation analytics on Spark.

Message tables in, decisions / violations / escalations / events and
dashboard metrics out, all as DataFrame plans.
"""

__version__ = "0.1.0"
