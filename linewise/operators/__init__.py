"""linewise.operators"""
