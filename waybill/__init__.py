"""Waybill: operational-validity analytics for delivery records on Spark."""
