"""linewise.functions"""
