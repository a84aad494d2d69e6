"""Booking, seating, crew and fleet analytics as Spark DataFrame operators."""
