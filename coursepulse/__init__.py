"""Learner-engagement analytics for online courses, as Spark DataFrame transformations."""

from coursepulse.plans.course import CourseTables

__all__ = ["CourseTables"]
