"""Spark-native reliability analytics: effects, risk scores, certificates and their audits as DataFrame operators."""
